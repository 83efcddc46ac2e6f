"""Who may see what: organisations, accounts, the log library, user listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.columns import UNASSIGNED, account_key, account_name, environment, my_domain

ENVIRONMENT_ORDER = ("production", "sandbox", "developer", "scratch", "unknown")
STALE_DAYS = 30


@dataclass(frozen=True)
class Identity:
    username: str
    role: str = "user"

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"


def _own(who: Identity, owner: str = "owner") -> Column:
    return F.coalesce(F.col(owner) == who.username, F.lit(False)) & (F.col(owner) != "")


def org_visible(who: Identity) -> Column:
    """Public, or admin, or owner; a missing or unknown visibility reads as private."""
    return F.coalesce(F.col("visibility") == "public", F.lit(False)) | F.lit(who.is_admin) | _own(who)


def manageable(who: Identity, owner: str = "owner") -> Column:
    return F.lit(who.is_admin) | F.coalesce(_own(who, owner), F.lit(False))


def visible_orgs(registry: DataFrame, who: Identity) -> DataFrame:
    known = F.when(F.col("visibility").isin("public", "private"), F.col("visibility")).otherwise("private")
    return registry.filter(F.coalesce(org_visible(who), F.lit(False))).select(
        "org_id", "name", known.alias("visibility"), "owner", manageable(who).alias("can_manage"),
        F.nullif("account", F.lit("")).alias("account"), environment(F.col("instance_url")).alias("environment"),
        my_domain(F.col("instance_url")).alias("my_domain"), "instance_url",
    )


def filter_orgs(orgs: DataFrame, text: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "org_id", "name", "owner", "account", "environment"))
    return orgs.filter(hay.contains(text.strip().lower()))


def stale_orgs(registry: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    return registry.filter(F.col("extracted_days_ago") > days).select("org_id", "extracted_days_ago")


def account_suggestions(registry: DataFrame, who: Identity) -> DataFrame:
    """For each address: its domain, the visible orgs beside it, and the account to pre-fill."""
    seen = visible_orgs(registry, who).filter(F.col("my_domain").isNotNull())
    beside = seen.groupBy("my_domain").agg(
        F.count(F.lit(1)).alias("siblings"),
        F.min_by("account", F.when(F.col("account").isNotNull(), F.col("org_id"))).alias("matched_account"),
    )
    asked = registry.select(
        "org_id", my_domain(F.col("instance_url")).alias("my_domain"),
        environment(F.col("instance_url")).alias("environment"),
    )
    return asked.join(beside, "my_domain", "left").select(
        "org_id", "my_domain", "environment", "matched_account", F.coalesce("siblings", F.lit(0)).alias("siblings"),
        F.coalesce("matched_account", "my_domain").alias("suggestion"),
    )


def snapped_accounts(registry: DataFrame) -> DataFrame:
    """Each org's account in the spelling the first other org of that account uses."""
    named = registry.select("org_id", "account", account_key(F.col("account")).alias("key")).filter(
        F.col("key") != UNASSIGNED
    )
    order = Window.partitionBy("key").orderBy("org_id")
    firsts = (
        named.withColumn("r", F.row_number().over(order)).filter("r <= 2").groupBy("key").agg(
            F.min_by("org_id", "r").alias("first_org"), F.min_by("account", "r").alias("first_account"),
            F.max(F.when(F.col("r") == 2, F.col("account"))).alias("second_account"),
        )
    )
    other = F.when(F.col("org_id") != F.col("first_org"), F.col("first_account")).otherwise(F.col("second_account"))
    return named.join(firsts, "key").select(
        "org_id", "account", F.coalesce(other, account_name(F.col("account"))).alias("snapped")
    )


def account_list(orgs: DataFrame) -> DataFrame:
    """Accounts of the visible orgs with environments; unassigned last."""
    keyed = orgs.withColumn("key", account_key(F.col("account")))
    base = keyed.groupBy("key").agg(
        F.min_by("account", "org_id").alias("account"), F.count(F.lit(1)).alias("org_count"),
        F.bool_and("can_manage").alias("can_manage_all"), F.min("org_id").alias("first_org"),
    )
    envs = keyed.groupBy("key", "environment").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "environment", F.col("n").cast("string"))))).alias("environments")
    )
    return base.join(envs, "key").orderBy(F.col("account").isNull(), F.lower("account"), "key")


def account_spellings(registry: DataFrame) -> DataFrame:
    """The spelling to show per account: most used, then mixed case, then alphabetical."""
    named = registry.select(account_name(F.col("account")).alias("name")).filter(F.col("name").isNotNull())
    tally = named.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("key", F.lower("name"))
    best = F.struct(-F.col("uses"), F.col("name") == F.lower("name"), F.col("name"))
    return tally.groupBy("key").agg(
        F.min_by("name", best).alias("spelling"), F.sum("uses").alias("orgs"), F.count(F.lit(1)).alias("spellings")
    )


def grouped_orgs(orgs: DataFrame, registry: DataFrame, pinned_accounts: list[str], pinned_orgs: list[str], current: str | None) -> DataFrame:
    """Orgs in display order: pinned accounts, A-Z, unassigned last; inside, pinned, active, environment, id."""
    spell = account_spellings(registry).select(F.col("key").alias("sk"), "spelling")
    env_rank = F.array_position(F.array(*[F.lit(e) for e in ENVIRONMENT_ORDER]), F.col("environment"))
    return (
        orgs.withColumn("key", account_key(F.col("account"))).join(spell, F.col("key") == F.col("sk"), "left")
        .select(
            "org_id", "key", F.col("spelling").alias("group_name"), (F.col("key") == UNASSIGNED).alias("unassigned"),
            F.col("key").isin(pinned_accounts).alias("account_pinned"), F.col("org_id").isin(pinned_orgs).alias("org_pinned"),
            F.coalesce(F.col("org_id") == F.lit(current), F.lit(False)).alias("is_current"), env_rank.cast("bigint").alias("env_rank"),
        )
        .orderBy(
            "unassigned", F.desc("account_pinned"), F.lower("group_name"), F.desc("org_pinned"), F.desc("is_current"), "env_rank", "org_id"
        )
    )


def rename_gate(registry: DataFrame, who: Identity) -> DataFrame:
    """Per account: may the caller rename it?  Every visible member must be theirs to manage."""
    members = registry.withColumn("key", account_key(F.col("account"))).filter(F.col("key") != UNASSIGNED)
    seen = F.coalesce(org_visible(who), F.lit(False))
    return members.groupBy("key").agg(
        F.count_if(seen).alias("visible"), F.count_if(seen & ~manageable(who)).alias("blocked")
    ).withColumn(
        "verdict", F.when(F.col("visible") == 0, "not found").when(F.col("blocked") > 0, "refused").otherwise("allowed")
    )


def renamed(registry: DataFrame, old: str, new: str | None, who: Identity) -> DataFrame:
    """The registry after a rename; unchanged where the gate refuses."""
    key = F.lit(" ".join(old.split()).lower())
    wanted = " ".join(new.split()) if new and new.strip() else None
    gate = rename_gate(registry, who).filter((F.col("key") == key) & (F.col("verdict") == "allowed")).select(
        F.col("key").alias("gk")
    )
    moved = registry.withColumn("key", account_key(F.col("account"))).join(gate, F.col("key") == F.col("gk"), "left")
    moving = F.col("gk").isNotNull() & F.coalesce(org_visible(who), F.lit(False))
    target = F.lit(wanted)
    if wanted:
        others = moved.filter(~moving & (F.col("key") == wanted.lower()))
        existing = others.agg(F.min_by("account", "org_id").alias("a")).scalar()
        target = F.coalesce(existing, target)
    return moved.select("org_id", F.when(moving, target).otherwise(F.col("account")).alias("account"), moving.alias("moved"))


# ---- log library ------------------------------------------------------------


def decorated_logs(library: DataFrame, links: DataFrame, registry: DataFrame, who: Identity) -> DataFrame:
    """Logs the caller can see, with what is derived at read time."""
    orgs = registry.select(
        F.col("org_id").alias("r_org"), F.col("name").alias("org_name"), F.col("account").alias("org_account"),
        environment(F.col("instance_url")).alias("org_environment"),
        F.coalesce(org_visible(who), F.lit(False)).alias("org_seen"),
    )
    shown = links.join(orgs.filter("org_seen").select(F.col("r_org").alias("org_id")), "org_id", "left_semi")
    filed = shown.groupBy(F.col("log_id").alias("l_log")).agg(
        F.count(F.lit(1)).alias("incident_links"),
        F.max_by("incident_id", F.struct("filed_at", "incident_id")).alias("last_incident"),
    )
    tagged = library.join(orgs, F.col("org_id") == F.col("r_org"), "left")
    mine = manageable(who)
    seen = mine | F.col("r_org").isNull() | F.col("org_seen")
    return (
        tagged.filter(seen).join(filed, F.col("log_id") == F.col("l_log"), "left")
        .select(
            "log_id", "label", "source_log", "org_id", "org_name", "org_environment", "owner", "top_exception", "components",
            F.coalesce(F.when(F.col("r_org").isNotNull(), F.nullif("org_account", F.lit(""))), F.col("account")).alias("account"),
            F.coalesce("archived", F.lit(False)).alias("archived"), mine.alias("can_manage"),
            F.coalesce("incident_links", F.lit(0)).alias("incident_links"), "last_incident",
        )
    )


def search_logs(
    logs: DataFrame, who: Identity, q: str | None = None, org_id: str | None = None, account: str | None = None,
    owner: str | None = None, status: str = "active",
) -> DataFrame:
    """Newest first; every word of ``q`` must occur somewhere in the log's fields."""
    if status not in ("active", "archived", "all"):
        raise ValueError("status must be active, archived or all")
    if status != "all":
        logs = logs.filter(F.col("archived") == (status == "archived"))
    if org_id:
        logs = logs.filter(F.col("org_id") == org_id)
    if account:
        wanted = account if account == UNASSIGNED else " ".join(account.split()).lower()
        logs = logs.filter(account_key(F.col("account")) == wanted)
    if owner:
        logs = logs.filter(F.col("owner") == (who.username if owner == "me" else owner))
    hay = F.lower(
        F.concat_ws(
            " ", "label", "log_id", "source_log", "org_id", "org_name", "account", "owner", "top_exception", "components"
        )
    )
    for term in (q or "").lower().split():
        logs = logs.filter(hay.contains(term))
    return logs.orderBy(F.desc("log_id"))


def library_facets(logs: DataFrame) -> DataFrame:
    """Counts per account, org and owner, with the total and the archived, in one pass."""
    rows = logs.select(
        account_key(F.col("account")).alias("a"), F.coalesce("org_id", F.lit("")).alias("o"),
        F.coalesce("owner", F.lit("")).alias("w"), "archived",
    )
    a, o, w = F.col("a"), F.col("o"), F.col("w")
    sets = rows.groupingSets([[], [a], [o], [w]], a, o, w).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("count"), F.count_if("archived").alias("archived")
    )
    facet = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "account").when(F.col("gid") == 5, "org").otherwise("owner")
    return (
        sets.select(facet.alias("facet"), F.coalesce("a", "o", "w", F.lit("all")).alias("member"), "count", "archived")
        .filter("member <> ''").orderBy("facet", F.col("member") == UNASSIGNED, F.lower("member"))
    )


# ---- listings without secrets ----------------------------------------------


def user_listing(users: DataFrame) -> DataFrame:
    return users.select(
        "username", "role", "created_by", F.coalesce("verified", F.lit(False)).alias("verified"), "disabled", "display_name"
    ).orderBy("username")


def token_listing(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", "username", "kind", "name", "created_days_ago").orderBy("created_days_ago", "token_id")
