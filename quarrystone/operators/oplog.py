"""Append-only logs folded to state: entities, roles, links, folders, discussions, tombstones. Folds that only need the last
event per key are one grouping; those whose steps hang on each other run in order per workspace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.joins import as_of


def fold_entities(events: DataFrame) -> DataFrame:
    """(anchor, path, value, ts, event_id): the last value of each entity's path; ties by event id. Deleted paths (null) go."""
    last = events.filter("anchor is not null").groupBy("anchor", "path").agg(F.max_by(F.struct("value", "ts", "event_id"), F.struct("ts", "event_id")).alias("x"))
    return last.select("anchor", "path", "x.*").filter("value is not null")


def entity_table(state: DataFrame, paths: list[str]) -> DataFrame:
    """Folded state as one row per entity with a column per path."""
    return state.groupBy("anchor").pivot("path", paths).agg(F.first("value"))


ORDER = {"ins": 0, "seg": 1, "def": 2, "con": 3, "syn": 3, "eva": 4, "rec": 5}


def order_violations(events: DataFrame) -> DataFrame:
    """(event_id, anchor, op, after): events whose operator comes before one already seen for the entity: recorded, never blocked."""
    rank = F.create_map(*[F.lit(y) for kv in ORDER.items() for y in kv])[F.col("op")]
    w = Window.partitionBy("anchor").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("__r", rank).withColumn("__m", F.max(F.struct(F.col("__r").alias("r"), F.col("op").alias("o"))).over(w))
    return x.filter(F.col("__r") < F.col("__m.r")).select("event_id", "anchor", "op", F.col("__m.o").alias("after"))


def schema_events(profile: DataFrame) -> DataFrame:
    """An inferred schema as definition events on _schema paths, with what each reading rests on."""
    return profile.select(
        F.lit("def").alias("op"), F.concat(F.lit("_schema."), "field").alias("anchor"), F.lit("type").alias("path"), F.col("kind").alias("value"),
        F.concat_ws(" ", F.col("filled").cast("string"), F.lit("filled,"), F.col("n_distinct").cast("string"), F.lit("distinct")).alias("basis"),
    )


def gate(events: DataFrame, ledger: DataFrame, roles: list[str] = ("owner", "editor")) -> DataFrame:
    """Events with accepted and why: an event counts only if its sender's role at its time allows it. ledger (sender, since, role)."""
    x = as_of(events, ledger, ["sender"], "ts", "since", "role")
    why = F.when(F.col("role").isNull(), "no role then").when(~F.col("role").isin(list(roles)), F.concat(F.lit("role was "), F.col("role")))
    return x.withColumn("why", why).withColumn("accepted", F.col("why").isNull())


def resolve_links(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links with the verdict of the last decision on each (confirm, reject, change); rejected ones are kept and say so."""
    last = decisions.groupBy("id").agg(F.max_by(F.struct("decision", "relation"), F.struct("ts", "event_id")).alias("d"))
    j = links.join(last, "id", "left")
    return j.select(*[c for c in links.columns if c != "relation"], F.coalesce("d.relation", links.relation).alias("relation"), F.coalesce("d.decision", F.lit("open")).alias("decision"))


def tombstoned(rows: DataFrame, gone: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each row whose key was never removed."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").join(gone.select(key).distinct(), key, "left_anti")


def merge_devices(a: DataFrame, b: DataFrame, gone: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Two devices' manifests as one: the newer version of each row, removed ids never come back."""
    return tombstoned(a.unionByName(b, allowMissingColumns=True), gone, key, order)


def fold_reading(lines: DataFrame) -> dict[str, DataFrame]:
    """Counts of a reading's delta operations (source, seq, operator, key, other): cast, bonds and identities, by source and in
    all, with the source that had each first. Order only matters for that."""
    def tally(ops: list[str], keys: list):
        x = lines.filter(F.col("operator").isin(ops))
        return x.groupBy(*keys).agg(F.count("*").alias("mentions"), F.count_distinct("source").alias("sources"), F.min_by("source", "seq").alias("first"))

    pair = [F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")]
    return {"cast": tally(["INS"], ["key"]), "bonds": tally(["CON"], pair), "identities": tally(["REC"], ["key"])}


def ranked_cast(cast: DataFrame, most: int = 3000) -> DataFrame:
    return cast.withColumn("score", 10 * F.col("mentions") + F.col("sources")).orderBy(F.desc("score"), "key").limit(most)


def ranked_bonds(bonds: DataFrame, most: int = 1500) -> DataFrame:
    return bonds.withColumn("score", F.col("mentions") + 3 * F.col("sources")).orderBy(F.desc("score"), "a", "b").limit(most)


# ---- folders: steps hang on each other


def apply_drive(state: dict, e: dict) -> dict:
    """One event on {"folders": {id: {name, parent, trashed}}, "places": {source: folder}}; moves into a folder's own subtree
    and events on what isn't there are ignored."""
    f, p = dict(state["folders"]), dict(state["places"])
    op, i = e["op"], e["id"]
    if op == "folder" and i not in f:
        f[i] = {"name": e.get("name") or "", "parent": e.get("parent") if e.get("parent") in f else None, "trashed": False}
    elif op == "rename" and i in f:
        f[i] = {**f[i], "name": e.get("name") or ""}
    elif op == "move" and i in f:
        up, seen = e.get("parent"), set()
        while up is not None and up in f and up not in seen and up != i:
            seen.add(up)
            up = f[up]["parent"]
        if up != i and (e.get("parent") is None or e.get("parent") in f):
            f[i] = {**f[i], "parent": e.get("parent")}
    elif op in ("trash", "restore") and i in f:
        f[i] = {**f[i], "trashed": op == "trash"}
    elif op == "forget":
        f.pop(i, None)
        p.pop(i, None)
    elif op == "place":
        p[i] = e.get("parent") if e.get("parent") in f else None
    return {"folders": f, "places": p}


def inverse_drive(state: dict, e: dict) -> list[dict]:
    """The events that bring back what was visible before an event."""
    f, p, op, i = state["folders"], state["places"], e["op"], e["id"]
    if op == "folder":
        return [] if i in f else [{"op": "forget", "id": i}]
    if op == "rename":
        return [{"op": "rename", "id": i, "name": f[i]["name"]}] if i in f else []
    if op == "move":
        return [{"op": "move", "id": i, "parent": f[i]["parent"]}] if i in f else []
    if op in ("trash", "restore"):
        return [{"op": "trash" if f[i]["trashed"] else "restore", "id": i}] if i in f else []
    if op == "place":
        return [{"op": "place", "id": i, "parent": p[i]}] if i in p else [{"op": "forget", "id": i}]
    if op == "forget":
        back = [{"op": "folder", "id": i, "name": f[i]["name"], "parent": f[i]["parent"]}, *([{"op": "trash", "id": i}] if f[i]["trashed"] else [])] if i in f else []
        return back + ([{"op": "place", "id": i, "parent": p[i]}] if i in p else [])
    return []


def fold_drive(events: list[dict]) -> dict:
    s: dict = {"folders": {}, "places": {}}
    for e in events:
        s = apply_drive(s, e)
    return s


def drive_state(events: DataFrame) -> DataFrame:
    """(workspace, node, name, parent, trashed, is_folder) of events (workspace, ts, event_id, op, id, name, parent)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ts", "event_id"])
        recs = f[["op", "id", "name", "parent"]].astype(object).where(lambda d: d.notna(), None).to_dict("records")
        s = fold_drive(recs)
        ws = f["workspace"].iloc[0]
        rows = [(ws, i, x["name"], x["parent"], x["trashed"], True) for i, x in s["folders"].items()] + [(ws, i, "", x, False, False) for i, x in s["places"].items()]
        return pd.DataFrame(rows, columns=["workspace", "node", "name", "parent", "trashed", "is_folder"])

    return events.groupBy("workspace").applyInPandas(run, "workspace string, node string, name string, parent string, trashed boolean, is_folder boolean")


# ---- discussions


def fold_talk(events: DataFrame, ledger: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(comments, refused) of events (event_id, ts, sender, op, target, body): comments with their last edit by their author,
    deletions by author or owner, resolution; everything by someone without a role then is refused, with the reason."""
    g = gate(events, ledger, ["owner", "editor", "viewer"])
    ok, refused = g.filter("accepted").drop("role", "why", "accepted"), g.filter("not accepted").select("event_id", "why")
    posts = ok.filter("op = 'comment'").select(F.col("event_id").alias("id"), "ts", F.col("sender").alias("author"), F.col("target").alias("thread"), "body")
    on = ok.filter("op in ('edit', 'delete', 'resolve')").join(posts.select(F.col("id").alias("target"), "author"), "target")
    fair = on.filter(F.when(F.col("op") == "edit", F.col("sender") == F.col("author")).when(F.col("op") == "delete", (F.col("sender") == F.col("author")) | (F.col("sender") == owner)).otherwise(True))
    unfair = on.join(fair.select("event_id"), "event_id", "left_anti").select("event_id", F.lit("not the author").alias("why"))
    per = fair.groupBy(F.col("target").alias("id")).agg(
        F.max_by(F.when(F.col("op") == "edit", F.col("body")), F.when(F.col("op") == "edit", F.struct("ts", "event_id"))).alias("edited"),
        F.bool_or(F.col("op") == "delete").alias("deleted"), F.bool_or(F.col("op") == "resolve").alias("resolved"),
    )
    c = posts.join(per, "id", "left").select("id", "ts", "author", "thread", F.coalesce("edited", "body").alias("body"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("resolved", F.lit(False)).alias("resolved"))
    return c, refused.unionByName(unfair)


def inbox(comments: DataFrame, marks: DataFrame, me: str, which: str = "unread") -> DataFrame:
    """Comments of others after my last read mark (marks: thread, me, up_to), or open, resolved, mine, or mentioning me."""
    m = marks.filter(F.col("me") == me).groupBy("thread").agg(F.max("up_to").alias("up_to"))
    x = comments.filter("not deleted").join(m, "thread", "left")
    return {
        "unread": x.filter((F.col("author") != me) & (F.col("up_to").isNull() | (F.col("ts") > F.col("up_to")))),
        "open": x.filter("not resolved"), "resolved": x.filter("resolved"), "mine": x.filter(F.col("author") == me),
        "mentions": x.filter(F.contains("body", F.lit("@" + me))),
    }[which].drop("up_to")


def apply_edits(referents: list[str], edits: list[dict]) -> tuple[dict[str, str], list[dict]]:
    """Merges (SYN a b), splits (SEG a) and ties in log order on names: what each name stands for, and the edits skipped with why."""
    to = {r: r for r in referents}
    skipped = []

    def root(x: str) -> str:
        while to[x] != x:
            x = to[x]
        return x

    for e in edits:
        if e["a"] not in to or e.get("b") not in to and e["op"] == "SYN":
            skipped.append({**e, "why": "no such referent"})
        elif e["op"] == "SYN":
            a, b = root(e["a"]), root(e["b"])
            if a == b:
                skipped.append({**e, "why": "already one"})
            else:
                to[b] = a
        elif e["op"] == "SEG":
            if root(e["a"]) == e["a"] and not any(x != e["a"] and root(x) == e["a"] for x in to):
                skipped.append({**e, "why": "nothing to part"})
            else:
                heirs = [x for x in to if x != e["a"] and root(x) == root(e["a"])]
                r = root(e["a"])
                to[e["a"]] = e["a"]
                if r == e["a"] and heirs:
                    for h in heirs:
                        to[h] = heirs[0]
    return {x: root(x) for x in to}, skipped


def latest_event(df: DataFrame, at: str) -> DataFrame:
    """The row with the latest time stamp (ties: the greatest row)."""
    return df.filter(F.col(at).isNotNull()).agg(F.max(F.struct(at, *[c for c in df.columns if c != at])).alias("x")).select("x.*")
