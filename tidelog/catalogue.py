"""Typed attribute catalogues: which attributes exist and which activity may carry them.

Two variants are in use. ``SERVICE`` is the one the write path checks against;
``SIMULATOR`` is the one the synthetic-load tools follow. They differ in a few
attributes, in the record type of channel and call events, and in most of the
per-activity lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Record types.
RECORD_TYPES = ("MESSAGE", "MODERATION", "PURCHASE", "SYSTEM", "OTHER")

# Activity types with the record type the service files them under.
SERVICE_ACTIVITIES = """
REGISTRATION SYSTEM
LOGIN SYSTEM
LOGOUT SYSTEM
MESSAGE_SENT MESSAGE
MESSAGE_DELETED MESSAGE
MESSAGE_EDITED MESSAGE
MESSAGE_READ MESSAGE
REACTION_ADDED MESSAGE
REACTION_REMOVED MESSAGE
MODERATION_FLAG MODERATION
MODERATION_APPROVE MODERATION
MODERATION_REJECT MODERATION
PURCHASE_INITIATED PURCHASE
PURCHASE_COMPLETED PURCHASE
PURCHASE_REFUNDED PURCHASE
PROFILE_UPDATED SYSTEM
AVATAR_CHANGED SYSTEM
STATUS_CHANGED SYSTEM
CHANNEL_CREATED SYSTEM
CHANNEL_JOINED SYSTEM
CHANNEL_LEFT SYSTEM
CHANNEL_DELETED SYSTEM
FILE_UPLOADED MESSAGE
FILE_DOWNLOADED MESSAGE
FILE_DELETED MESSAGE
CALL_STARTED SYSTEM
CALL_ENDED SYSTEM
CALL_MISSED SYSTEM
SEARCH_PERFORMED OTHER
NOTIFICATION_RECEIVED OTHER
"""

# Activities the simulator files under another record type.
SIMULATOR_RECORD_TYPES = """
CHANNEL_JOINED MESSAGE
CHANNEL_LEFT MESSAGE
CALL_STARTED MESSAGE
CALL_ENDED MESSAGE
CALL_MISSED MESSAGE
"""

# Service attributes, "name kind" and, for kind enum, the allowed values.
# The attribute "type" allows the 30 activity names above.
SERVICE_ATTRIBUTES = """
timestamp date
user_id long
session_id text
user_device_type enum ANDROID IOS WEB DESKTOP
platform_version text
app_version text
terminal_type enum ONEME BASIC PRO ENTERPRISE
org_hash text
gender enum 0 1 2
user_active_status flag
lang enum ru en de fr zh es
source enum mobile web backend desktop
chat_id long
message_id long
message_length long
has_attachments flag
attachment_count long
attachment_type enum IMAGE VIDEO AUDIO FILE STICKER
is_forwarded flag
is_reply flag
reaction_type enum LIKE LOVE LAUGH SAD ANGRY WOW
channel_id long
thread_id long
source_chat_id long
moderation_score long
moderation_category enum SPAM HATE ADULT VIOLENCE OTHER
moderation_action enum FLAGGED APPROVED REJECTED DELETED
report_count long
is_automated flag
user_group_admin flag
user_chat_admin flag
group_promo flag
amount_cents long
currency enum USD EUR RUB GBP
product_id text
payment_method enum CARD WALLET INVOICE
is_trial flag
subscription_tier enum FREE BASIC PRO ENTERPRISE
email_verified flag
phone_verified flag
age_group enum 18-24 25-34 35-44 45-54 55+
country_code text
timezone text
member_count long
is_public flag
channel_type enum GROUP CHANNEL DM BROADCAST
other_user_id long
limit_reached flag
friendship_request_source enum SEARCH CONTACT QR INVITE_LINK
file_size_kb long
file_type enum IMAGE VIDEO AUDIO DOCUMENT ARCHIVE
mime_type text
call_duration_sec long
is_video flag
participant_count long
query_length long
search_scope enum MESSAGES USERS CHANNELS FILES GLOBAL
"""

# Attributes the simulator defines differently or in addition.
SIMULATOR_CHANGED_ATTRIBUTES = """
timestamp long
source enum web ios android
call_type enum AUDIO VIDEO SCREEN_SHARE
"""

# Service attributes the simulator does not have.
SIMULATOR_DROPPED_ATTRIBUTES = """
source_chat_id user_group_admin user_chat_admin group_promo other_user_id
limit_reached friendship_request_source is_video search_scope
"""

# Attributes each activity may carry in the service.
SERVICE_ACTIVITY_ATTRIBUTES = """
REGISTRATION session_id user_device_type platform_version lang terminal_type org_hash
LOGIN session_id user_device_type platform_version app_version lang
LOGOUT session_id user_device_type
MESSAGE_SENT chat_id message_id message_length has_attachments attachment_count attachment_type is_forwarded is_reply source_chat_id lang source user_group_admin user_chat_admin
MESSAGE_DELETED chat_id message_id user_chat_admin source
MESSAGE_EDITED chat_id message_id message_length lang source
MESSAGE_READ chat_id message_id source
REACTION_ADDED chat_id message_id reaction_type source
REACTION_REMOVED chat_id message_id reaction_type source
MODERATION_FLAG chat_id message_id moderation_score moderation_category is_automated report_count lang source group_promo
MODERATION_APPROVE chat_id message_id moderation_action is_automated source
MODERATION_REJECT chat_id message_id moderation_action moderation_category is_automated user_chat_admin source
PURCHASE_INITIATED amount_cents currency product_id payment_method is_trial
PURCHASE_COMPLETED amount_cents currency product_id payment_method is_trial subscription_tier
PURCHASE_REFUNDED amount_cents currency product_id
PROFILE_UPDATED email_verified phone_verified age_group country_code gender
AVATAR_CHANGED user_device_type file_size_kb
STATUS_CHANGED user_active_status lang
CHANNEL_CREATED channel_id channel_type is_public member_count
CHANNEL_JOINED channel_id channel_type member_count
CHANNEL_LEFT channel_id channel_type
CHANNEL_DELETED channel_id channel_type member_count
FILE_UPLOADED chat_id file_size_kb file_type mime_type has_attachments source
FILE_DOWNLOADED chat_id file_size_kb file_type source
FILE_DELETED chat_id file_size_kb file_type source
CALL_STARTED chat_id is_video participant_count
CALL_ENDED chat_id call_duration_sec is_video participant_count
CALL_MISSED chat_id is_video
SEARCH_PERFORMED query_length search_scope lang
NOTIFICATION_RECEIVED user_device_type channel_id
"""

# Attributes each activity may carry in the simulator.
SIMULATOR_ACTIVITY_ATTRIBUTES = """
REGISTRATION session_id user_device_type terminal_type org_hash gender user_active_status email_verified phone_verified lang country_code timezone age_group app_version source
LOGIN session_id user_device_type terminal_type org_hash user_active_status lang country_code source
LOGOUT session_id user_device_type source
MESSAGE_SENT chat_id message_id message_length has_attachments attachment_count attachment_type is_forwarded is_reply lang channel_id thread_id source
MESSAGE_DELETED chat_id message_id channel_id
MESSAGE_EDITED chat_id message_id message_length channel_id
MESSAGE_READ chat_id message_id channel_id thread_id
REACTION_ADDED chat_id message_id reaction_type channel_id
REACTION_REMOVED chat_id message_id reaction_type
MODERATION_FLAG chat_id message_id moderation_score moderation_category moderation_action report_count is_automated channel_id
MODERATION_APPROVE chat_id message_id moderation_action is_automated
MODERATION_REJECT chat_id message_id moderation_category moderation_action report_count is_automated
PURCHASE_INITIATED amount_cents currency product_id payment_method is_trial subscription_tier source
PURCHASE_COMPLETED amount_cents currency product_id payment_method is_trial subscription_tier source
PURCHASE_REFUNDED amount_cents currency product_id
PROFILE_UPDATED email_verified phone_verified lang country_code timezone age_group
AVATAR_CHANGED file_size_kb mime_type
STATUS_CHANGED user_active_status lang
CHANNEL_CREATED channel_id member_count is_public channel_type lang
CHANNEL_JOINED channel_id member_count is_public channel_type
CHANNEL_LEFT channel_id member_count
CHANNEL_DELETED channel_id member_count is_public
FILE_UPLOADED chat_id message_id file_size_kb file_type mime_type channel_id
FILE_DOWNLOADED file_size_kb file_type mime_type
FILE_DELETED file_size_kb file_type
CALL_STARTED chat_id call_type participant_count channel_id
CALL_ENDED chat_id call_type call_duration_sec participant_count
CALL_MISSED chat_id call_type
SEARCH_PERFORMED query_length lang source
NOTIFICATION_RECEIVED source lang
"""

# Every record may carry these, whatever its activity.
REQUIRED_ATTRIBUTES = ("type", "timestamp", "user_id")


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str  # long, flag, text, enum or date
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalogue:
    name: str
    attributes: dict[str, Attribute] = field(hash=False)
    record_type_of: dict[str, str] = field(hash=False)
    extras: dict[str, tuple[str, ...]] = field(hash=False)

    @property
    def activities(self) -> tuple[str, ...]:
        return tuple(self.record_type_of)

    def allowed_keys(self, activity: str) -> tuple[str, ...]:
        return REQUIRED_ATTRIBUTES + self.extras[activity]


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def _attributes(text: str) -> dict[str, Attribute]:
    return {r[0]: Attribute(r[0], r[1], tuple(r[2:])) for r in _rows(text)}


def _lists(text: str) -> dict[str, tuple[str, ...]]:
    return {r[0]: tuple(r[1:]) for r in _rows(text)}


def _service() -> Catalogue:
    record_types = dict(_rows(SERVICE_ACTIVITIES))
    attributes = {"type": Attribute("type", "enum", tuple(record_types))}
    attributes.update(_attributes(SERVICE_ATTRIBUTES))
    return Catalogue("service", attributes, record_types, _lists(SERVICE_ACTIVITY_ATTRIBUTES))


def _simulator() -> Catalogue:
    base = _service()
    dropped = set(SIMULATOR_DROPPED_ATTRIBUTES.split())
    attributes = {n: a for n, a in base.attributes.items() if n not in dropped}
    attributes.update(_attributes(SIMULATOR_CHANGED_ATTRIBUTES))
    record_types = {**base.record_type_of, **dict(_rows(SIMULATOR_RECORD_TYPES))}
    return Catalogue("simulator", attributes, record_types, _lists(SIMULATOR_ACTIVITY_ATTRIBUTES))


SERVICE = _service()
SIMULATOR = _simulator()
