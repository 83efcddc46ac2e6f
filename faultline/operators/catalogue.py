"""Fixed tables of the activity ledger: channels, route catalogue, browser actions, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
CHANNELS = {
    "web": "Web UI",
    "chat": "In-app AI chat",
    "mcp-remote": "MCP (remote /mcp)",
    "mcp-stdio": "MCP (local stdio)",
    "api": "API token (script, or an older MCP copy)",
}
MCP = ("mcp-remote", "mcp-stdio")
LABELLED = ("chat", "mcp-remote", "mcp-stdio")

# method, route, action, category, label, mode
CATALOGUE = """
POST|/api/auth/signup|auth.signup|Account|Signed up|always
POST|/api/auth/login|auth.login|Account|Signed in|always
POST|/api/auth/logout|auth.logout|Account|Signed out|always
POST|/api/auth/password|auth.password_change|Account|Changed password|always
GET|/api/auth/signup-config|auth.signup_config|Account||never
GET|/api/auth/me|auth.me|Account||never
GET|/api/build|app.build|Account||never
GET|/api/admin/users|admin.users_list|Admin|Listed users|nonweb
POST|/api/admin/users|admin.user_create|Admin|Created a user|always
PATCH|/api/admin/users/{username}/verified|admin.user_verify|Admin|Verified a user|always
PATCH|/api/admin/users/{username}/limits|admin.user_limits|Admin|Set a user's limits|always
GET|/api/admin/limits|admin.limits_view|Admin||never
PUT|/api/admin/limits|admin.limits_update|Admin|Changed default limits|always
PATCH|/api/admin/users/{username}/role|admin.user_role|Admin|Changed a role|always
PATCH|/api/admin/users/{username}/disabled|admin.user_disable|Admin|Enabled/disabled a user|always
POST|/api/admin/users/{username}/reset-password|admin.password_reset|Admin|Reset a password|always
DELETE|/api/admin/users/{username}|admin.user_delete|Admin|Deleted a user|always
GET|/api/admin/usage|admin.usage_view|Admin||never
GET|/api/admin/activity|admin.activity_view|Admin||never
GET|/api/admin/activity/export|admin.activity_export|Admin|Exported activity|always
POST|/api/chat/key|admin.llm_key_store|Admin|Stored an LLM key|always
DELETE|/api/chat/key|admin.llm_key_delete|Admin|Removed an LLM key|always
GET|/api/tokens|tokens.list|Tokens|Listed API tokens|nonweb
POST|/api/tokens|tokens.create|Tokens|Created an API token|always
DELETE|/api/tokens/{token_id}|tokens.revoke|Tokens|Revoked an API token|always
POST|/api/orgs|org.connect|Orgs|Connected an org|always
GET|/api/orgs|org.list|Orgs|Listed orgs|nonweb
GET|/api/orgs/{org_id}/status|org.status|Orgs|Checked fetch status|nonweb
GET|/api/orgs/{org_id}/visibility|org.visibility_view|Orgs||never
PATCH|/api/orgs/{org_id}/visibility|org.visibility|Orgs|Changed org visibility|always
PATCH|/api/orgs/{org_id}/account|org.set_account|Orgs|Assigned org to account|always
GET|/api/accounts|account.list|Orgs|Listed accounts|nonweb
GET|/api/accounts/suggest|account.suggest|Orgs||never
POST|/api/accounts/rename|account.rename|Orgs|Renamed an account|always
POST|/api/orgs/{org_id}/refresh|org.refresh|Orgs|Refreshed an org|always
GET|/api/orgs/{org_id}/stats|kb.stats|Knowledgebase|Org stats|nonweb
GET|/api/orgs/{org_id}/components/{component_id}|kb.component|Knowledgebase|Opened a component|always
GET|/api/orgs/{org_id}/object-touch/{object_name}|kb.object_touch|Knowledgebase|Object touch map|always
GET|/api/orgs/{org_id}/field-writers/{field_name}|kb.field_writers|Knowledgebase|Field writers|always
GET|/api/orgs/{org_id}/search|kb.search|Knowledgebase|Knowledgebase search|always
GET|/api/orgs/{org_id}/inbound/{component_id}|kb.inbound|Knowledgebase|Inbound references|always
GET|/api/orgs/{org_id}/entry-points/{object_name}|kb.entry_points|Knowledgebase|Entry points|always
POST|/api/orgs/{org_id}/incidents|incident.file|Incidents|Filed an incident|always
GET|/api/orgs/{org_id}/incidents|incident.list|Incidents|Listed incidents|nonweb
GET|/api/orgs/{org_id}/incidents/{incident_id}|incident.view|Incidents|Opened an incident|always
POST|/api/orgs/{org_id}/resolve|incident.resolve|Incidents|Recorded a resolution|always
GET|/api/orgs/{org_id}/known-issues|known.list|Incidents|Listed known issues|nonweb
GET|/api/triage/known|triage.known_lookup|Incidents|Triage: known-issue lookup|always
POST|/api/logs/normalize|log.parse|Logs|Parsed a debug log|always
GET|/api/logs|log.list|Logs|Listed stored logs|nonweb
GET|/api/logs/facets|log.facets|Logs||never
PATCH|/api/logs/{log_id}|log.update|Logs|Edited/archived a log|always
DELETE|/api/logs/{log_id}|log.delete|Logs|Deleted a log|always
GET|/api/logs/{log_id}|log.view|Logs|Opened a stored log|always
GET|/api/logs/{log_id}/download|log.download|Logs|Downloaded a log|always
GET|/api/chat/key|chat.key_state|Chat||never
GET|/api/llm|chat.llm_state|Chat||never
POST|/api/chat/unlock|chat.unlock|Chat|Unlocked a personal key|always
POST|/api/chat/default-model|chat.set_model|Chat|Changed default model|always
GET|/api/chat/models|chat.models|Chat||never
GET|/api/chats|chat.list|Chat||never
POST|/api/chats|chat.new|Chat|Started a conversation|always
GET|/api/chats/{chat_id}|chat.open|Chat|Opened a conversation|always
DELETE|/api/chats/{chat_id}|chat.delete|Chat|Deleted a conversation|always
POST|/api/chats/{chat_id}/messages|chat.ask|Chat|Asked the AI|always
POST|/api/chats/{chat_id}/share|share.create|Sharing|Shared a conversation|always
DELETE|/api/chats/{chat_id}/share|share.revoke|Sharing|Unshared a conversation|always
GET|/api/shared/{token}|share.view|Sharing|Shared link opened|always
GET|/api/usage/me|usage.me|Account||never
GET|/api/me/guide|guide.get|Account||never
POST|/api/me/guide|guide.post|Account||never
GET|/api/home|home.view|Account||never
GET|/api/activity/me|activity.me|Account||never
GET|/api/usage/summary|usage.summary|Account||never
POST|/api/activity/events|activity.ui|UI||never
"""

ANONYMOUS_OK = ("share.view",)

# action, category, label
UI_ACTIONS = """
ui.view|Navigation|Opened a tab
ui.palette_open|Navigation|Opened the command palette
ui.palette_run|Navigation|Ran a palette command
ui.tour_start|Help|Started a tour
ui.tour_done|Help|Finished a tour
ui.help_open|Help|Opened the help drawer
ui.demo_open|Help|Opened the demo case
ui.triage_submit|Incidents|Used the triage bar
ui.chat_dock|Chat|Opened the chat dock
ui.copy|Productivity|Copied to clipboard
ui.export|Productivity|Exported/downloaded from the UI
ui.log_upload|Logs|Chose a log to parse
ui.feedback|Chat|Rated an answer
"""
UI_META_KEYS = ("view", "command", "tour", "target", "kind", "value")
UI_SAFE_TOKEN = r"^[A-Za-z0-9_.:\-/ ]{1,60}$"
UI_BATCH_MAX, UI_HOURLY_MAX, UI_CLOCK_SECONDS = 50, 600, 900

LADDER = {
    "active": "Active",
    "kb": "Looked up org metadata",
    "log": "Parsed a debug log",
    "incident": "Filed an incident",
    "resolve": "Recorded a resolution",
}
# -----------------------------------------------------------------------------


def _rows(text: str) -> list[tuple]:
    return [tuple(line.split("|")) for line in text.strip().splitlines()]


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(CATALOGUE), "method string, route string, action string, category string, label string, mode string")


def ui_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(UI_ACTIONS), "action string, category string, label string")


def action_labels() -> dict[str, str]:
    """action -> label; the first labelled route of an action wins."""
    out: dict[str, str] = {}
    for _m, _r, action, _c, label, _mode in _rows(CATALOGUE):
        if label:
            out.setdefault(action, label)
    for action, _c, label in _rows(UI_ACTIONS):
        out.setdefault(action, label)
    out.setdefault("mcp.connect", "MCP client connected")
    return out


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def action_label(action: Column) -> Column:
    return _lookup(action_labels(), action)


def channel_label(channel: Column) -> Column:
    return _lookup(CHANNELS, channel)
