"""The fold against a sequential model, on fixed cases and random logs."""

import json
import random

import pytest

from fleetctx.functions.scalars import DEFAULT
from fleetctx.operators import fold
from fleetctx.sources import log


def seed():
    return [
        log.event("plan.open", "planner", 1, title="Goal", project="alpha"),
        log.event("plan.open", "planner", 2, title="Task", kind="task", root_id=1, project="alpha"),
        log.event("plan.claim", "builder-a", 3, node=2, project="alpha"),
        log.event("decision.make", "planner", 4, subject="s", choice="c", binds="b", scope_root=1, project="alpha"),
        log.event("claim.assert", "builder-a", 5, subject="x", predicate="is", body="y", confidence=0.5, project="alpha"),
    ]


def rows(df, *key):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


def tally(events, **how):
    return fold.tallies(events, **how).first().asDict()


def model(events):
    """Replays plan and decision events one by one."""
    tables, counts = {"plan": {}, "decision": {}}, {"plan_node": 0, "decision": 0, "skipped": 0, "cross_tenant": 0}
    for e in sorted(events, key=lambda e: e[0]):
        eid, _, kind, actor, project, p = e
        table = "plan" if kind.startswith("plan") else "decision"
        opens = kind in ("plan.open", "decision.make")
        if opens:
            target = p.get("node_id" if table == "plan" else "decision_id")
            target = eid if target is None else target
        else:
            target = (p.get("node") or p.get("node_id")) if table == "plan" else (p.get("decision") or p.get("decision_id") or p.get("target"))
        if target is None:
            counts["skipped"] += 1
            continue
        held = tables[table].get(target)
        if held and held["project"] != project:
            counts["cross_tenant"] += 1
            continue
        counts["plan_node" if table == "plan" else "decision"] += 1
        if opens:
            tables[table][target] = {"status": p.get("status") or ("open" if table == "plan" else "standing"), "project": project, "owner": p.get("owner") or actor, "title": p.get("title") or "", "shared": int(bool(p.get("shared")))}
        elif held:
            held["status"] = {"plan.claim": "claimed", "plan.done": "done", "plan.block": "blocked"}.get(kind, "superseded")
            owner = p.get("owner") or (actor if kind == "plan.claim" else None)
            if table == "plan" and owner:
                held["owner"] = owner
    return tables, counts


def test_five_events(spark):
    events = log.frame(spark, seed())
    assert tally(events) == {"events": 5, "plan_node": 3, "decision": 1, "claim": 1, "awareness": 0, "skipped": 0, "cross_tenant": 0, "dead_letter": 0, "last_event_id": 5}
    node = rows(fold.plan_node(events), "id")[(2,)]
    assert (node["status"], node["owner"], node["root_id"], node["kind"], node["origin"]) == ("claimed", "builder-a", 1, "task", "alpha")
    assert rows(fold.claim(events), "asserted_by")[(5,)]["confidence"] == 0.5
    assert tally(events, after=5)["events"] == 0
    assert tally(events, upto=1)["events"] == 1 and tally(events, after=1)["events"] == 4


@pytest.mark.parametrize("rng_seed", range(3))
def test_fold_equals_replay_on_random_logs(spark, rng_seed):
    rng = random.Random(rng_seed)
    kinds = ["plan.open", "plan.claim", "plan.done", "plan.block", "decision.make", "decision.supersede"]
    events = []
    for eid in range(1, 250):
        kind, p = rng.choice(kinds), {}
        ident = rng.choice([None, 0, *range(1, 12)])
        if ident is not None:
            p[{"plan.open": "node_id", "decision.make": "decision_id", "decision.supersede": "decision"}.get(kind, rng.choice(["node", "node_id"]))] = ident
        for k, v in (("owner", rng.choice(["", "x", "y"])), ("shared", rng.choice([0, 1, True])), ("title", f"t{eid}"), ("subject", f"s{eid}")):
            if rng.random() < 0.5:
                p[k] = v
        events.append((eid, 1.0, kind, rng.choice("ab"), rng.choice(["alpha", "bravo"]), p))
    df = spark.createDataFrame([(e[0], e[1], e[2], e[3], e[4], json.dumps(e[5])) for e in events], "id long, ts double, kind string, actor string, project string, payload string")
    tables, counts = model(events)
    got = {k[0]: (r["status"], r["project"], r["owner"], r["title"], r["shared"]) for k, r in rows(fold.plan_node(df), "id").items()}
    assert got == {k: (r["status"], r["project"], r["owner"], r["title"], r["shared"]) for k, r in tables["plan"].items()}
    got = {k[0]: (r["status"], r["project"], r["shared"]) for k, r in rows(fold.decision(df), "id").items()}
    assert got == {k: (r["status"], r["project"], r["shared"]) for k, r in tables["decision"].items()}
    told = tally(df)
    assert {k: told[k] for k in counts} == counts
    first, second = tally(df, upto=100), tally(df, after=100)
    assert all(first[k] + second[k] == told[k] for k in ("events", *counts))


def test_tenant_guard(spark):
    more = [log.event("plan.done", "spy", 6, node=2, project="bravo"), log.event("decision.supersede", "spy", 7, decision=4, project="bravo")]
    events = log.frame(spark, [*seed(), *more])
    told = tally(events, after=5)
    assert (told["events"], told["cross_tenant"], told["plan_node"]) == (2, 2, 0)
    assert rows(fold.plan_node(events), "id")[(2,)]["status"] == "claimed" and rows(fold.decision(events), "id")[(4,)]["status"] == "standing"


def test_unknown_and_broken_events(spark):
    df = spark.createDataFrame([(1, 1.0, "weird", "a", "p", "{}"), (2, 1.0, "plan.open", "a", "p", '{"title": "x'), (3, 1.0, "plan.done", "a", "p", '[1, 2]'), (4, 1.0, "plan.done", "a", None, '{"node": "2"}'), (5, 1.0, None, "a", "p", None)], "id long, ts double, kind string, actor string, project string, payload string")
    told = tally(df)
    assert (told["events"], told["skipped"], told["last_event_id"]) == (5, 3, 5)
    node = rows(fold.plan_node(df), "id")[(2,)]
    assert (node["title"], node["kind"], node["status"]) == ("", "goal", "open")


def test_presence(spark):
    events = [log.event("session.start", "a", 1, role="lead", task="t1", project="p"), log.event("session.end", "a", 2, project="q"), log.event("session.end", "b", 3)]
    got = rows(fold.awareness(log.frame(spark, events)), "agent_id")
    assert (got[("a",)]["role"], got[("a",)]["task_head"], got[("a",)]["status"], got[("a",)]["project"]) == ("lead", "t1", "idle", "q")
    assert (got[("b",)]["role"], got[("b",)]["task_head"], got[("b",)]["project"]) == (None, None, DEFAULT)
    beats = spark.createDataFrame([("a", ["x" * 400] * 9, "active", 9.0, None), ("ghost", [], "active", 9.0, None)], "agent_id string, files_hot array<string>, status string, updated_at double, project string")
    seen = rows(fold.awareness(log.frame(spark, events), beats), "agent_id")
    assert ("ghost",) not in seen and len(seen[("a",)]["files_hot"]) == 8 and len(seen[("a",)]["files_hot"][0]) == 300 and seen[("a",)]["status"] == "active"


def test_first_event_wins_and_ids_keep_gaps(spark):
    e = lambda k: log.event("observation", "a", k, q=f"q{k % 3}")
    df = log.first_wins(log.frame(spark, [e(0), e(0), e(3), e(1), e(1), e(2)]))
    assert sorted(r.id for r in df.collect()) == [1, 4, 6]
    assert log.append(df, log.frame(spark, [e(1), e(4)], first_id=7)).count() == 0
    with pytest.raises(ValueError):
        log.event("plan.done", "a", 1, title="no such field")


def test_snapshot_is_published_whole(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert log.latest(spark, root) == ({}, 0)
    events = log.frame(spark, seed())
    log.publish(spark, fold.snapshot(events), root, 5)
    tables, cursor = log.latest(spark, root)
    assert cursor == 5 and all(fold.same(tables[k].select(*v.columns), v) for k, v in fold.snapshot(events).items())


def test_old_tables_gain_columns(spark, tmp_path):
    path = f"file://{tmp_path}/decision"
    assert log.read_table(spark, path, "decision").count() == 0
    spark.createDataFrame([(1, None, "s", "c", "r", "b", "standing")], "id long, scope_root long, subject string, choice string, rationale string, binds string, status string").write.parquet(path)
    row = log.read_table(spark, path, "decision").first()
    assert (row.project, row.origin, row.shared) == ("default", None, 0)


def test_telemetry_keeps_forty_of_a_batch(spark):
    calls = spark.createDataFrame([("b", k, "s", "t" * 99, "", "An ERROR here" if k else "fine" + "." * 90 + "error", 1.0, None) for k in range(60)], "batch string, seq long, session string, tool string, path string, response string, ts double, project string")
    out = log.telemetry(calls).collect()
    assert len(out) == 40 and sum(r.is_error for r in out) == 39 and {(len(r.tool), r.path, r.project) for r in out} == {(80, None, "default")}
