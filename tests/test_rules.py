"""Every rule over every pair and triple of upstream kinds, against a brute-force reading of the rules."""

import itertools

from pyspark.sql import functions as F

from flowgauge.functions import vocab
from flowgauge.operators import rules

KINDS = {"S": ("success", None), "K": ("skipped", "manual"), "N": ("skipped", None), "R": ("skipped", "rule"),
         "F": ("failed", None), "B": ("upstream_failed", None), "P": ("running", None), "W": ("waiting_decision", None)}


def expected(rule, ups):
    ok = sum(u == "S" for u in ups)
    bad = sum(u in "FB" for u in ups)
    skipped = sum(u in "KNR" for u in ups)
    ruled = sum(u == "R" for u in ups)
    open_ = sum(u in "PW" for u in ups)
    if rule not in vocab.TRIGGER_RULES:
        return "fail"
    if not ups:
        return "ready"
    met = {
        "all_success": not open_ and not bad and not ruled, "one_success": ok > 0, "all_done": not open_,
        "all_skipped": not open_ and skipped == len(ups), "none_skipped": not open_ and not skipped, "one_failed": bad > 0,
        "all_failed": not open_ and bad == len(ups), "none_failed": not open_ and not bad,
        "none_failed_min_one_success": not open_ and not bad and ok > 0,
    }[rule]
    if met:
        return "ready"
    if open_:
        return "wait"
    averse = rule in ("all_success", "one_success", "none_failed", "none_failed_min_one_success")
    return "upstream_failed" if averse and bad else "skip"


def test_truth_table(spark):
    tasks, edges, want = [], [], {}
    run = 0
    for rule in (*vocab.TRIGGER_RULES, "always", "one_done"):
        for ups in itertools.chain([()], itertools.product(KINDS, repeat=2), itertools.combinations_with_replacement(KINDS, 3)):
            run += 1
            tasks.append((run, 0, rule, "waiting", None, None))
            want[run] = expected(rule, ups)
            for n, kind in enumerate(ups, 1):
                tasks.append((run, n, "all_success", *KINDS[kind], None))
                edges.append((run, 0, n))
    t = spark.createDataFrame(tasks, "run_id long, task_no int, trigger_rule string, status string, skip_origin string,"
                                     " finished_at timestamp_ntz")
    e = spark.createDataFrame(edges, "run_id long, task_no int, upstream_no int")
    judged = rules.evaluate_rules(rules.upstream_counts(t, e)).where("task_no = 0")
    got = {r.run_id: r.verdict for r in judged.select("run_id", "verdict").collect()}
    assert got == want


def test_missing_upstream_is_named(spark):
    t = spark.createDataFrame([(1, 2, "all_done", "waiting", None, None)],
                              "run_id long, task_no int, trigger_rule string, status string, skip_origin string,"
                              " finished_at timestamp_ntz")
    e = spark.createDataFrame([(1, 2, 1)], "run_id long, task_no int, upstream_no int")
    assert rules.upstream_counts(t, e).select("missing_upstream").first()[0] == 1


def test_unknown_rule_lists_the_known(spark):
    t = spark.createDataFrame([(1, 2, "sometimes", "waiting", None, None)],
                              "run_id long, task_no int, trigger_rule string, status string, skip_origin string,"
                              " finished_at timestamp_ntz")
    e = spark.createDataFrame([], "run_id long, task_no int, upstream_no int")
    reason = rules.evaluate_rules(rules.upstream_counts(t, e)).select("reason").first()[0]
    assert reason.startswith("unknown trigger_rule 'sometimes'; known rules: ['all_done', 'all_failed'")
