"""Chains of workspace states: whether each state may follow the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A state. ``approval`` names the device that was proposed; ``state_hash`` and ``prev`` chain states.
SCHEMA = """workspace string, revision int, scope string, epoch int, prev string, state_hash string, action string, author string, tail long,
members map<string, struct<role: string, joined: int, history_from: int>>, devices map<string, struct<user: string, history: boolean>>,
removed array<string>, key_commitment string, target_device string, target_user string"""


def _keys(m: str) -> Column:
    return F.coalesce(F.map_keys(m), F.array())


def _less(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def _same_map(a: str, b: str) -> Column:
    """Maps have no equality: their sorted entries have."""
    return F.sort_array(F.map_entries(a)).eqNullSafe(F.sort_array(F.map_entries(b)))


def _same_list(a: str, b: str) -> Column:
    return F.sort_array(a).eqNullSafe(F.sort_array(b))


def transitions(states: DataFrame) -> DataFrame:
    """workspace, revision and ``fault``: null for a state that may stand, else the first rule that it breaks.

    A workspace's states meet their predecessor by one window; no state is fetched. Signatures and votes are the
    caller's matter: ``replicate.approved`` counts votes. A missing revision is a chain fault of the next one.
    """
    own = Window.partitionBy("workspace").orderBy("revision")
    s = states.withColumn("p", F.lag(F.struct(*[c for c in states.columns if c != "workspace"])).over(own))
    # The actions there are
    known = ("create", "membership", "remove", "history", "history_activate", "self_approve", "quorum_approve", "personal_recover")
    user = F.when(F.col("action") == "personal_recover", F.col("devices")[F.col("author")]["user"]).when(F.col("p").isNull(), F.col("devices")[F.col("author")]["user"]).otherwise(F.col("p.devices")[F.col("author")]["user"])
    s = s.withColumn("_user", user)
    admin = F.coalesce(F.col("p.members")[F.col("_user")]["role"] == "admin", F.lit(False))
    added, gone = _less(_keys("devices"), _keys("p.devices")), _less(_keys("p.devices"), _keys("devices"))
    new_users, lost_users = _less(_keys("members"), _keys("p.members")), _less(_keys("p.members"), _keys("members"))
    same_members, same_devices, same_removed = _same_map("members", "p.members"), _same_map("devices", "p.devices"), _same_list("removed", "p.removed")
    next_epoch, same_epoch = F.col("epoch") == F.col("p.epoch") + 1, F.col("epoch") == F.col("p.epoch")
    kept = lambda m, but: F.forall(_keys(f"p.{m}"), lambda k: F.array_contains(but, k) | F.col(m)[k].eqNullSafe(F.col(f"p.{m}")[k]))
    tombstones = (F.size(_less(F.col("p.removed"), F.col("removed"))) == 0) & (F.size(_less(gone, F.col("removed"))) == 0)

    malformed = ~F.col("scope").isin("personal", "team") | ~F.col("action").isin(*known) | F.exists(F.map_values("members"), lambda m: ~m["role"].isin("admin", "member") | (m["joined"] < 1) | (m["joined"] > F.col("epoch")) | (m["history_from"] < 1) | (m["history_from"] > F.col("epoch"))) | F.exists(F.map_values("devices"), lambda d: ~F.array_contains(_keys("members"), d["user"])) | F.arrays_overlap(_keys("devices"), F.col("removed"))
    genesis = (F.col("revision") == 1) & F.col("prev").isNull() & (F.col("epoch") == 1) & (F.col("action") == "create") & (F.col("tail") == 0) & (F.size("members") == 1) & (F.size("devices") == 1) & (F.size("removed") == 0) & F.coalesce(F.col("members")[F.col("_user")]["role"] == "admin", F.lit(False))
    chain = (F.col("revision") == F.col("p.revision") + 1) & F.col("prev").eqNullSafe(F.col("p.state_hash")) & (F.col("scope") == F.col("p.scope"))
    boundary = F.when(same_epoch, F.col("tail") == F.col("p.tail")).when(F.col("epoch") > F.col("p.epoch"), F.col("tail") >= F.col("p.tail")).otherwise(False)

    adds_one = same_members & same_removed & next_epoch & (F.size(added) == 1) & (F.size(gone) == 0) & F.coalesce(F.get(added, F.lit(0)) == F.col("target_device"), F.lit(False)) & ~F.coalesce(F.array_contains("p.removed", F.col("target_device")), F.lit(False)) & kept("devices", F.array().cast("array<string>"))
    device = F.col("devices")[F.col("target_device")]
    right_user = F.coalesce(device["user"] == F.col("target_user"), F.lit(False))
    self_ = adds_one & right_user & (F.col("_user") == F.col("target_user")) & device["history"].eqNullSafe(F.col("p.devices")[F.col("author")]["history"])
    quorum_ = adds_one & right_user & device["history"].eqNullSafe(F.lit(False))
    recover = adds_one & right_user & (F.col("p.scope") == "personal") & F.array_contains(_keys("p.members"), F.col("target_user"))
    steady = same_removed & same_epoch & F.col("key_commitment").eqNullSafe(F.col("p.key_commitment"))
    history = admin & steady & (F.size(added) + F.size(gone) + F.size(new_users) + F.size(lost_users) == 0) & F.forall(_keys("p.devices"), lambda k: F.col("devices")[k]["user"].eqNullSafe(F.col("p.devices")[k]["user"]) & (~F.col("p.devices")[k]["history"] | F.col("devices")[k]["history"])) & F.forall(
        _keys("p.members"), lambda k: (F.col("members")[k]["role"] == F.col("p.members")[k]["role"]) & (F.col("members")[k]["joined"] == F.col("p.members")[k]["joined"]) & (F.col("members")[k]["history_from"] <= F.col("p.members")[k]["history_from"]))
    activate = steady & same_members & (F.size(added) + F.size(gone) == 0) & F.coalesce(~F.col("p.devices")[F.col("target_device")]["history"] & device["history"], F.lit(False)) & kept("devices", F.array("target_device"))
    remove = admin & same_members & next_epoch & (F.size(gone) > 0) & (F.size(added) == 0) & tombstones & kept("devices", gone)
    of = lambda m, k: F.col(m)[k]["user"]
    membership = admin & next_epoch & (same_members | (F.col("scope") == "team")) & tombstones & F.forall(added, lambda d: F.array_contains(new_users, of("devices", d))) & F.forall(gone, lambda d: F.array_contains(lost_users, of("p.devices", d))) & F.forall(
        _keys("p.devices"), lambda d: F.array_contains(lost_users, of("p.devices", d)) | F.col("devices")[d].eqNullSafe(F.col("p.devices")[d])) & F.forall(
        _keys("members"), lambda u: F.when(F.array_contains(new_users, u), (F.col("members")[u]["joined"] == F.col("epoch")) & (F.col("members")[u]["history_from"] == F.col("epoch"))).otherwise((F.col("members")[u]["joined"] == F.col("p.members")[u]["joined"]) & (F.col("members")[u]["history_from"] == F.col("p.members")[u]["history_from"])))
    rules = {"self_approve": self_, "quorum_approve": quorum_, "personal_recover": recover, "history": history, "history_activate": activate, "remove": remove, "membership": membership}
    allowed = F.lit(False)
    for action, rule in rules.items():
        allowed = F.when(F.col("action") == action, F.coalesce(rule, F.lit(False))).otherwise(allowed)
    broken = lambda rule: ~F.coalesce(rule, F.lit(False))  # noqa: E731  a rule that can't be judged is broken
    fault = F.when(F.coalesce(malformed, F.lit(True)), "malformed").when(F.col("_user").isNull(), "author").when(F.col("p").isNull(), F.when(broken(genesis), "genesis")).when(broken(chain), "chain").when(broken(boundary), "boundary").when(~allowed, F.col("action"))
    return s.select("workspace", "revision", "action", fault.alias("fault"))
