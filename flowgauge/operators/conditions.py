"""Asset conditions: JSON trees flattened to node tables, leaves answered by as-of look-ups, groups evaluated upwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowgauge.functions import calendar as cal, text
from flowgauge.functions.schedules import strip
from flowgauge.operators import asof
from flowgauge.session import cut_lineage

# The keys a condition and a group may have.
LEAF_KEYS = ("asset_name", "freshness_hours", "consecutive_days")
GROUP_KEYS = ("operator", "assets")
_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def _get(name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("node"), f"$.{name}", kind)


def _type_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _unknown_keys(keys: Column, known) -> Column:
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0


def _classified(frontier: DataFrame, named_leaves: bool) -> DataFrame:
    """Each node's kind (``leaf``, ``AND``, ``OR``) with its fields, and what is wrong with it if anything is."""
    shape = _type_of(F.col("node"))
    is_object = shape.startswith("OBJECT")
    keys = F.coalesce(F.json_object_keys(F.to_json("node")), F.array().cast("array<string>"))
    base = frontier.withColumns({
        "shape": shape, "keys": F.when(is_object, keys).otherwise(F.array().cast("array<string>")),
    })
    is_group = F.array_contains("keys", "operator")
    is_leaf = ~is_group & F.array_contains("keys", "asset_name")
    bare = (F.col("shape") == "STRING") & F.lit(named_leaves)
    name = F.when(bare, F.try_variant_get("node", "$", "string")).otherwise(
        F.when(_type_of(_get("asset_name")) == "STRING", _get("asset_name", "string")))
    members = F.try_variant_get(F.col("node"), "$.assets", "array<variant>")
    operator = F.when(_type_of(_get("operator")) == "STRING", _get("operator", "string"))
    fresh_type, run_type = _type_of(_get("freshness_hours")), _type_of(_get("consecutive_days"))
    hours, days = _get("freshness_hours", "double"), _get("consecutive_days", "int")
    has_hours, has_days = fresh_type != "VOID", run_type != "VOID"
    problem = (
        F.when(bare, F.when(strip(name) == "", "empty asset name"))
        .when(~is_object, "not an object")
        .when(is_group & _unknown_keys(F.col("keys"), GROUP_KEYS), "unknown keys in group")
        .when(is_group & ~F.coalesce(operator.isin("AND", "OR"), F.lit(False)), "operator must be AND or OR")
        .when(is_group & ~F.coalesce(F.size(members) > 0, F.lit(False)), "group without members")
        .when(is_leaf & _unknown_keys(F.col("keys"), LEAF_KEYS), "unknown keys in condition")
        .when(is_leaf & (F.coalesce(strip(name), F.lit("")) == ""), "empty asset name")
        .when(is_leaf & has_hours & ~F.coalesce(fresh_type.rlike(_NUMBERS) & (hours > 0), F.lit(False)),
              "freshness_hours must be positive")
        .when(is_leaf & has_days & ~F.coalesce(run_type.rlike("^(BIGINT|INT|SMALLINT|TINYINT)") & (days >= 1), F.lit(False)),
              "consecutive_days must be at least 1")
        .when(is_leaf & has_hours & has_days, "two windows at once")
        .when(~is_leaf & ~is_group, "neither a condition nor a group")
    )
    return base.select(
        "spec_id", "node_id", "parent_id", "depth",
        F.when(is_group, operator).otherwise("leaf").alias("op"), F.when(is_leaf | bare, name).alias("asset_name"),
        F.when(is_leaf & has_hours, hours).alias("freshness_hours"),
        F.when(is_leaf & has_days, days).alias("consecutive_days"), problem.alias("problem"),
        F.when(is_group, members).alias("members"))


def _members(parents: DataFrame) -> DataFrame:
    return parents.select(
        "spec_id", F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"),
        F.posexplode("members").alias("pos", "node")).select(
        "spec_id", F.concat("parent_id", F.lit("."), F.col("pos").cast("string")).alias("node_id"), "parent_id",
        "depth", "node")


_NODE_COLUMNS = ["spec_id", "node_id", "parent_id", "depth", "op", "asset_name", "freshness_hours", "consecutive_days",
                 "problem"]


def flatten_conditions(specs: DataFrame, column: str, kind: str = "schedule") -> DataFrame:
    """One row per node of each spec's JSON text, the root first; ``problem`` says what makes a node unusable.

    ``kind`` is ``schedule`` (one group, bare names are conditions) or ``wait_for`` (a list, which is an AND of its
    items). One round per nesting level, for all specs at once.
    """
    document = F.try_parse_json(F.col(column))
    root = specs.select(
        "spec_id", F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"),
        document.alias("node"))
    done = []
    if kind == "wait_for":
        items = F.try_variant_get(F.col("node"), "$", "array<variant>")
        is_list = F.coalesce(F.schema_of_variant("node").startswith("ARRAY"), F.lit(False))
        level = root.select(
            "spec_id", "node_id", "parent_id", "depth", F.lit("AND").alias("op"),
            F.lit(None).cast("string").alias("asset_name"), F.lit(None).cast("double").alias("freshness_hours"),
            F.lit(None).cast("int").alias("consecutive_days"), F.when(~is_list, "not a list").alias("problem"),
            F.when(is_list, items).alias("members"))
    else:
        level = _classified(root, True).withColumn("problem", F.coalesce(
            "problem", F.when(F.col("op") == "leaf", "a schedule must be a group")))
    while True:
        level = cut_lineage(level)
        done.append(level.select(*_NODE_COLUMNS))
        children = _members(level.where("problem IS NULL AND members IS NOT NULL"))
        if children.isEmpty():
            break
        level = _classified(children, kind == "schedule")
    return reduce(DataFrame.unionByName, done)


def usable_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of specs without a problem anywhere."""
    bad = nodes.where("problem IS NOT NULL").select("spec_id").distinct()
    return nodes.join(bad, "spec_id", "left_anti").drop("problem")


def asset_names_of(nodes: DataFrame) -> DataFrame:
    """The distinct assets a spec names at any depth."""
    return nodes.where("op = 'leaf'").select("spec_id", "asset_name").distinct()


def evaluate_tree(nodes: DataFrame, leaves: DataFrame, key: list[str], max_depth: int) -> DataFrame:
    """The root's ``ready`` and ``enabled_at`` per ``key`` (which includes ``spec_id``), groups evaluated upwards.

    ``leaves`` has ``ready`` and ``at`` per key and node. One grouped aggregate per level of the deepest tree; an AND
    holds from its latest member, an OR from its earliest ready one, members without a time give none.
    """
    groups = nodes.where("op <> 'leaf'").select("spec_id", "node_id", "parent_id", "depth", "op")
    parents = groups.select("spec_id", F.col("node_id").alias("parent_id"), F.col("op").alias("parent_op"))
    evaluated = leaves.select(*key, "node_id", "ready", "at")
    positions = nodes.select("spec_id", "node_id", "parent_id", "depth")
    state = evaluated.join(positions, ["spec_id", "node_id"])
    if max_depth > 1:
        state = cut_lineage(state)  # every level reads its own leaves: answer them once
    ready_at = F.when(F.col("ready"), F.col("at"))
    level = state.where(F.col("depth") == max_depth)
    for depth in range(max_depth, 0, -1):
        rolled = level.join(parents, ["spec_id", "parent_id"]).groupBy(*key, "parent_id", "parent_op").agg(
            F.bool_and("ready").alias("all_ready"), F.bool_or("ready").alias("any_ready"),
            F.max(ready_at).alias("newest"), F.min(ready_at).alias("oldest"))
        is_and = F.col("parent_op") == "AND"
        ready = F.when(is_and, F.col("all_ready")).otherwise(F.col("any_ready"))
        rolled = rolled.select(
            *key, F.col("parent_id").alias("node_id"), ready.alias("ready"),
            F.when(ready, F.when(is_and, F.col("newest")).otherwise(F.col("oldest"))).alias("at"),
        ).join(positions, ["spec_id", "node_id"])
        level = state.where(F.col("depth") == depth - 1).unionByName(rolled.select(*state.columns))
    return level.select(*key, "ready", F.when(F.col("ready"), F.col("at")).alias("enabled_at"))


def answer_leaves(nodes: DataFrame, evaluations: DataFrame, facts: DataFrame) -> DataFrame:
    """Every leaf of each evaluation (``spec_id``, ``target_date``, ``now``): ready, reason and the time of its fact."""
    leaves = nodes.where("op = 'leaf'").select(
        "spec_id", "node_id", "asset_name", F.col("freshness_hours").alias("hours"),
        F.col("consecutive_days").alias("days")).join(evaluations, "spec_id")
    keep = ["spec_id", "node_id", "asset_name", "target_date", "now", "ready", "reason"]
    plain = asof.latest(leaves.where("hours IS NULL AND days IS NULL"), facts)
    fresh = asof.within(leaves.where("hours IS NOT NULL"), facts)
    spans = asof.consecutive(leaves.where("days IS NOT NULL"), facts)
    none = F.lit(None).cast("timestamp_ntz")
    return plain.select(*keep, F.col("event_time").alias("at")).unionByName(
        fresh.select(*keep, F.col("event_time").alias("at"))).unionByName(spans.select(*keep, none.alias("at")))


def evaluate_conditions(nodes: DataFrame, evaluations: DataFrame, facts: DataFrame, max_depth: int) -> DataFrame:
    leaves = answer_leaves(nodes, evaluations, facts)
    return evaluate_tree(nodes, leaves, ["spec_id", "target_date", "now"], max_depth)


def depth_of(nodes: DataFrame) -> int:
    """The deepest nesting of the node table: the only value a plan of levels needs to know."""
    return nodes.agg(F.max("depth")).first()[0] or 0


# Push evaluation: which consumers a fact starts.


def consumers_of(facts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each fact with the consumers it concerns: subscribed to its asset by then, not its producer, not suppressed."""
    subs = subscriptions.select("asset_name", F.col("pipeline").alias("consumer"), "subscribed_at")
    live = facts.where(F.col("cascade") != "none")
    return live.join(subs, "asset_name").where(
        (F.col("consumer") != F.coalesce("source_dag", F.lit("")))
        & (F.col("subscribed_at").isNull() | (F.col("event_time") >= F.col("subscribed_at"))))


def _leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("op = 'leaf'").select(
        "spec_id", "node_id", "asset_name", F.col("freshness_hours").alias("hours"), F.col("consecutive_days").alias("days"))


def _condensed(nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All of ``facts`` that verdicts as of a moment depend on: the first time of each date, and the stretches of events that
    freshness asks for."""
    firsts = facts.groupBy("asset_name", "partition_date", "granularity").agg(F.min("event_time").alias("event_time"))
    return cut_lineage(firsts), cut_lineage(asof.stretches(facts, _leaves(nodes).where("hours IS NOT NULL")))


def schedule_holds(nodes: DataFrame, moments: DataFrame, facts: DataFrame, max_depth: int) -> DataFrame:
    """Whether each spec holds for ``target_date`` as of ``cutoff``, counting only facts recorded by then."""
    return _holds(nodes, moments, *_condensed(nodes, facts), max_depth)


def _holds(nodes: DataFrame, moments: DataFrame, firsts: DataFrame, known: DataFrame, max_depth: int) -> DataFrame:
    key = ["spec_id", "target_date", "cutoff"]
    leaves = _leaves(nodes).join(moments.select(*key).distinct(), "spec_id")
    keep = [*key, "node_id", "ready"]
    answered = asof.latest_ready_as_of(leaves.where("hours IS NULL AND days IS NULL"), firsts).select(*keep)
    answered = answered.unionByName(asof.within_ready_as_of(leaves.where("hours IS NOT NULL"), firsts, known).select(*keep))
    answered = answered.unionByName(
        asof.consecutive_ready_as_of(leaves.where("days IS NOT NULL"), firsts).select(*keep))
    timed = answered.withColumn("at", F.lit(None).cast("timestamp_ntz"))
    return evaluate_tree(nodes, timed, key, max_depth).select(*key, F.col("ready").alias("holds"))


def _turns(nodes: DataFrame, firsts: DataFrame, known: DataFrame) -> DataFrame:
    """The moments at which the verdict on a spec may change, whatever its target."""
    leaves, after = _leaves(nodes), F.expr("interval 1 microsecond")
    fresh = known.join(leaves.where("hours IS NOT NULL").select("spec_id", "asset_name", "hours"), ["asset_name", "hours"])
    ends = F.col("last") + asof._hours(F.col("hours")) + after
    begun = firsts.join(leaves.select("spec_id", "asset_name"), "asset_name").select("spec_id", F.col("event_time").alias("turn"))
    return begun.unionByName(fresh.select("spec_id", F.explode(F.array("first", ends)).alias("turn"))).where(
        "turn IS NOT NULL").distinct()


def holding_spans(nodes: DataFrame, asked: DataFrame, pairs: DataFrame, all_facts: DataFrame, max_depth: int) -> DataFrame:
    """When each spec holds for the dates of ``pairs`` (spec_id, target_date, cutoff): spans from ``begins`` to before ``ends``
    (null: open), no two of a spec and date overlap. ``asked`` has how many ``moments`` lie between which for each of these.

    A verdict changes only when a date's first fact comes and when a stretch of events that freshness asks for begins or has
    expired. So it is asked at these turns and at the first of a date's moments, not at each moment; where a date has
    fewer moments than turns lie between them, at the moments themselves.
    """
    key = ["spec_id", "target_date"]
    firsts, known = _condensed(nodes, all_facts)
    turns = cut_lineage(_turns(nodes, firsts, known).withColumn("day", F.to_date("turn")))
    asked = cut_lineage(asked.where("moments > 0 AND target_date IS NOT NULL"))
    days = asked.withColumn("day", F.explode(F.sequence(F.to_date("since"), F.to_date("until"))))
    held = days.join(turns.groupBy("spec_id", "day").agg(F.count("*").alias("held")), ["spec_id", "day"]).groupBy(*key, "moments").agg(
        F.sum("held").alias("held"))
    few = cut_lineage(held.where("held >= moments").select(*key))
    inside = days.join(few, key, "left_anti").join(turns, ["spec_id", "day"]).where("turn > since AND turn <= until")
    moments = asked.select(*key, F.col("since").alias("cutoff")).unionByName(inside.select(*key, F.col("turn").alias("cutoff")))
    if not few.isEmpty():
        moments = moments.unionByName(pairs.join(few, key, "left_semi").where("cutoff IS NOT NULL").select(*key, "cutoff"))
    judged = _holds(nodes, cut_lineage(moments.distinct()), firsts, known, max_depth).groupBy(*key, "cutoff").agg(
        F.coalesce(F.bool_or("holds"), F.lit(False)).alias("holds"))
    order = Window.partitionBy(*key).orderBy("cutoff")
    changed = judged.withColumn("before", F.lag("holds").over(order)).where("before IS NULL OR before <> holds")
    spans = changed.withColumn("ends", F.lead("cutoff").over(order)).where("holds")
    return cut_lineage(spans.select(*key, F.col("cutoff").alias("begins"), "ends"))


def push_requests(facts: DataFrame, subscriptions: DataFrame, nodes: DataFrame, all_facts: DataFrame,
                  max_depth: int) -> DataFrame:
    """The runs new facts request, one row per deterministic run name.

    A ``cascade = all`` fact starts its consumers unconditionally; any other only where the whole schedule holds as of
    the fact's own time. An AND schedule runs once per date, an OR schedule or an unconditional start once per event.
    """
    roots = nodes.where("parent_id IS NULL").select(F.col("spec_id").alias("consumer"), F.col("op").alias("operator")).distinct()
    named = asset_names_of(nodes).select(F.col("spec_id").alias("pipeline"), "asset_name")
    wanted = cut_lineage(subscriptions.join(named, ["pipeline", "asset_name"], "left_semi"))
    auto = F.when(F.col("cascade") != "all", F.col("event_time"))
    dates = facts.where("cascade <> 'none'").groupBy("asset_name", "partition_date").agg(
        F.min(auto).alias("since"), F.max(auto).alias("until"), F.count(auto).alias("moments"))
    dates = cut_lineage(dates.join(wanted.select("asset_name", F.col("pipeline").alias("consumer")).distinct(), "asset_name").groupBy(
        "consumer", "partition_date").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.sum("moments").alias("moments")))
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    live = facts.where("cascade <> 'none'").select(
        "asset_name", "partition_date", "event_time", F.when(F.col("cascade") == "all", "all").otherwise("auto").alias("cascade"),
        "source_dag").distinct().withColumn("event", F.concat_ws("|", "asset_name", stamp))  # few, before they meet consumers
    pairs = consumers_of(live, wanted)
    moments = consumers_of(facts.where("cascade <> 'all'"), wanted).select(
        F.col("consumer").alias("spec_id"), F.col("partition_date").alias("target_date"), F.col("event_time").alias("cutoff"))
    asked = dates.withColumnsRenamed({"consumer": "spec_id", "partition_date": "target_date"})
    spans = holding_spans(nodes, asked, moments, all_facts, max_depth).select(
        F.col("spec_id").alias("holder"), F.col("target_date").alias("held_date"), "begins", "ends")
    day = F.date_format("partition_date", "yyyy-MM-dd")
    names = cut_lineage(dates.join(roots, "consumer").select(
        F.col("consumer").alias("named"), F.col("partition_date").alias("named_date"), "operator", day.alias("run_date"),
        text.run_stem(F.col("consumer"), day, F.lit("ev")).alias("stem"),
        text.run_name(F.col("consumer"), day, F.lit("and"), F.lit("")).alias("and_name")))
    judged = pairs.join(names, (F.col("consumer") == F.col("named")) & F.col("partition_date").eqNullSafe(F.col("named_date"))).join(
        spans, (F.col("consumer") == F.col("holder")) & (F.col("partition_date") == F.col("held_date"))
        & (F.col("begins") <= F.col("event_time")) & (F.col("ends").isNull() | (F.col("event_time") < F.col("ends"))), "left").where(
        (F.col("cascade") == "all") | F.col("begins").isNotNull())
    per_event = (F.col("cascade") == "all") | (F.col("operator") == "OR")
    name = F.concat("stem", text.run_digest(F.col("consumer"), F.col("run_date"), F.lit("ev"), F.col("event")))
    return judged.select(
        F.when(per_event, name).otherwise(F.col("and_name")).alias("run_name"), "consumer", "run_date",
        F.when(per_event, "ev").otherwise("and").alias("kind"), F.when(per_event, F.col("asset_name")).alias("trigger_asset"),
        "event_time").groupBy("run_name", "consumer", "run_date", "kind", "trigger_asset").agg(
        F.min("event_time").alias("first_event_time"))


def replay_requests(requests: DataFrame, started: DataFrame) -> DataFrame:
    """Requests whose run was not started yet, by its deterministic name.

    Names take far less room in files than in memory, so they are merged by shuffle.
    """
    return requests.join(started.select("run_name").hint("merge"), "run_name", "left_anti")


def waiting_runs(facts: DataFrame, waits: DataFrame) -> DataFrame:
    """The runs to look at again for new facts: those with a task waiting on a fact's asset, with how many wait.

    The facts are reduced to their assets first: a hot asset is one row of the join.
    """
    assets = facts.select("asset_name").distinct()
    return waits.join(assets, "asset_name", "left_semi").groupBy("run_id").agg(
        F.count_distinct("task_no").alias("waiting_tasks"))
