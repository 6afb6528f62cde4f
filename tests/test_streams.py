import json
import random
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.runtime import share_code
from threadloom.sources import paged, table_transport
from threadloom.streaming import chain, claims


class Given:
    """Replies by url, each a list of (status, headers, body), and a clock that runs by what is slept."""

    def __init__(self, replies):
        self.replies, self.clock, self.slept, self.asked = replies, 0.0, [], []

    def get(self, url):
        self.asked.append((url, self.clock))
        found = self.replies[url]
        return found.pop(0) if len(found) > 1 else found[0]

    def now(self):
        return self.clock

    def sleep(self, s):
        self.slept.append(s)
        self.clock += s


def client(t, **more):
    return paged.Client(t, paged.TokenBucket(t), **more)


def test_bucket_paces_after_its_burst():
    t = Given({})
    bucket = paged.TokenBucket(t)
    for _ in range(20):
        bucket.take()
    assert t.slept == []
    for _ in range(16):
        bucket.take()
    assert abs(t.clock - 30) < 1e-6  # 8 in 15 seconds
    t.clock += 3600
    for _ in range(20):
        bucket.take()
    assert abs(t.clock - 3630) < 1e-6


def test_retries_wait_as_they_are_told():
    t = Given({"u": [(429, {"Retry-After": "77"}, ""), (429, {}, ""), (200, {}, "[1]")]})
    assert client(t).get("u") == [1] and t.slept == [77, 60]
    t = Given({"u": [(500, {}, ""), (503, {}, ""), (200, {}, "2")]})
    assert client(t).get("u") == 2 and t.slept == [1, 2]
    with pytest.raises(OSError):
        client(Given({"u": [(404, {}, "")]}), retries=1).get("u")


def listing(ids, times, total=None, offset=0):
    return f"b/backend-api/conversations?offset={offset}&limit=100&order=updated", [(200, {}, json.dumps({"items": [{"id": i, "update_time": t} for i, t in zip(ids, times, strict=True)], **({} if total is None else {"total": total})}))]


def test_pages_overlap_and_stop_at_the_frontier():
    ids = [f"c{k}" for k in range(250)]
    times = [1000.0 - k for k in range(250)]
    replies = dict(listing(ids[a : a + 100], times[a : a + 100], 250, a) for a in (0, 80, 160))
    got = [i.id for i in paged.offset_pages(client(Given(replies)), "b", lambda page: False)]
    assert got == ids
    t = Given(replies)
    span = paged.Span(start=paged.moment(895.0))
    assert [i.id for i in paged.offset_pages(client(t), "b", span.reached) if span.holds(i)] == ids[:106] and len(t.asked) == 2
    for broken in (dict([listing(ids[:100], times[:100], 250), listing(ids[130:230], times[130:230], 250, 80)]), dict([listing(ids[:100], times[:100], 250), listing(ids[80:180], times[80:180], 200, 80)]), dict([listing(ids[:100], times[:100], 250), listing([], [], 250, 80)])):
        with pytest.raises(OSError):
            list(paged.offset_pages(client(Given(broken)), "b", lambda page: False))


def test_one_listing_of_an_organisation():
    t = Given({"b/api/organizations": [(200, {}, '[{"uuid": "o"}]')], "b/api/organizations/o/chat_conversations": [(200, {}, json.dumps([{"uuid": "x", "updated_at": "2024-01-01T00:00:00Z"}, {"uuid": "y", "created_at": "2024-01-02T00:00:00+00:00"}]))]})
    assert [(i.id, i.url) for i in paged.whole_list(client(t), "b", lambda p: False)] == [("y", "b/api/organizations/o/chat_conversations/y"), ("x", "b/api/organizations/o/chat_conversations/x")]


def serve(spark, path, rows):
    """Writes a service of (id, seconds)."""
    df = spark.createDataFrame([(i, float(t), f"title {i}", json.dumps({"of": i, "at": t})) for i, t in rows], "id string, update_time double, title string, detail string")
    table_transport.replies(df).orderBy("url").write.mode("overwrite").parquet(path)


def test_source_reads_batches_and_resumes_streams(spark, tmp_path):
    share_code(spark)
    spark.dataSource.register(paged.PagedConversations)
    replies, options = str(tmp_path / "replies"), {"transport": "threadloom.sources.table_transport:make"}
    rows = [(f"c{k:03}", 1000 + k // 3) for k in range(330)]
    serve(spark, replies, rows)
    options["replies"] = replies
    got = spark.read.format("paged_conversations").options(**options).load().collect()
    assert {(r["id"], json.loads(r["body"])["of"]) for r in got} == {(i, i) for i, _ in rows} and len(got) == 330
    since = datetime.fromtimestamp(1100, UTC).isoformat()
    assert sorted(r["id"] for r in spark.read.format("paged_conversations").options(**options, since=since).load().collect()) == [i for i, t in rows if t >= 1100]

    def run():
        q = spark.readStream.format("paged_conversations").options(**options, since=since).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        return sorted((r["id"], json.loads(r["body"])["at"]) for r in spark.read.schema(paged.SCHEMA).parquet(str(tmp_path / "out")).collect())

    want = sorted((i, t) for i, t in rows if t >= 1100)
    assert run() == want
    assert run() == want  # a restart without news fetches nothing
    # one more at the newest time, one updated, one new
    rows = [*rows, ("same", 1109), ("new", 1200)]
    rows[0] = ("c000", 1150)
    serve(spark, replies, rows)
    assert run() == sorted([*want, ("same", 1109), ("new", 1200), ("c000", 1150)])


class Inbox:
    """A stream of claims over a folder, run batch by batch with restarts between."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        (path / "in").mkdir()

    def put(self, **message):
        self.n += 1
        (self.path / "in" / f"{self.n}.json").write_text(json.dumps({"source": "codex", **message}))

    def run(self, lease=600.0):
        got = []
        stream = claims.claims(claims.messages(self.spark, str(self.path / "in")), lease)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(self.path / "ck")).trigger(once=True).start()
        assert q.awaitTermination(120)
        return sorted((r["path"], r["mtime"], r["size"], r["attempt"], r["action"]) for r in got)


def test_claims_outlive_restarts(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    box.put(path="a", mtime=1, size=10)
    box.put(path="a", mtime=2, size=20)
    box.put(path="b", mtime=5, size=5)
    assert box.run() == [("a", 2, 20, 1, "claim"), ("b", 5, 5, 1, "claim")]
    box.put(path="a", mtime=2, size=20)  # claimed already
    box.put(path="b", mtime=6, size=6, parsed_mtime=5, parsed_size=5)  # changed while it was parsed
    assert box.run() == [("b", 6, 6, 2, "again")]
    box.put(path="a", mtime=2, size=20, parsed_mtime=2, parsed_size=20)
    box.put(path="b", mtime=6, size=6, parsed_mtime=5, parsed_size=5)  # of the claim before: ignored
    assert box.run() == [("a", 2, 20, 1, "done")]
    box.put(path="a", mtime=2, size=20)  # parsed already
    box.put(path="b", mtime=6, size=6, parsed_mtime=6, parsed_size=6)
    assert box.run() == [("b", 6, 6, 2, "done")]
    box.put(path="a", mtime=3, size=21)
    assert box.run(lease=0.001) == [("a", 3, 21, 1, "claim")]
    box.put(path="c", mtime=1, size=1)  # the next batch finds that the lease of a ran out
    assert box.run() == [("a", 3, 21, 2, "retry"), ("c", 1, 1, 1, "claim")]
    box.put(path="a", mtime=4, size=22)  # a newer record while it is claimed
    assert box.run() == []
    box.put(path="a", mtime=3, size=21, parsed_mtime=3, parsed_size=21)
    assert box.run() == [("a", 4, 22, 3, "again")]


def told(events):
    """Plain loops over (author, seq, event, parents) in order of arrival."""
    known, gaps, out = {}, {}, []
    for author, seq, event, parents in events:
        at = lambda k: known.get((author, k))  # noqa: B023, E731
        if at(seq) is not None:
            out.append((author, seq, event, "repeated" if at(seq) == event else "replay", False, None))
        elif (seq == 1 and parents) or (at(seq - 1) and at(seq - 1) not in parents) or (at(seq + 1) and event not in gaps.get((author, seq + 1), [])):
            out.append((author, seq, event, "broken", False, None))
        else:
            known[author, seq] = event
            fills = seq + 1 if at(seq + 1) else None
            if gap := seq > 1 and not at(seq - 1):
                gaps[author, seq] = parents
            gaps.pop((author, seq + 1), None)
            out.append((author, seq, event, "accepted", gap, fills))
    return out, gaps


def chain_events():
    r = random.Random(6)
    events = []
    for a in range(4):
        for s in range(1, 30):
            parents = [] if s == 1 else [f"{a}-{s - 1}"]
            if r.random() < 0.1:
                parents = ["elsewhere"]
            if r.random() > 0.1:
                events.append((f"a{a}", s, f"{a}-{s}", parents))
            if r.random() < 0.15:
                events.append((f"a{a}", s, r.choice([f"{a}-{s}", f"other{a}-{s}"]), parents))
    r.shuffle(events)
    return events


def test_chain_equals_plain_loops_in_batches_and_streams(spark, tmp_path):
    events, kind = chain_events(), "workspace string, author string, seq long, event string, parents array<string>, arrived long"
    want, gaps = told(events)
    assert {w[3] for w in want} == {"accepted", "repeated", "replay", "broken"} and gaps
    rows = [("w", *e, k) for k, e in enumerate(events)]
    flat = lambda df: sorted([tuple(r)[1:] for r in df.collect()], key=repr)
    batch = chain.verified(spark.createDataFrame(rows, kind).repartition(3))
    assert flat(batch) == sorted(want, key=repr)
    for k in range(2):  # two runs of a stream: the second begins with the state of the first
        half = len(rows) // 2
        spark.createDataFrame(rows[:half] if k == 0 else rows[half:], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = chain.verified(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "log"), format="parquet")
        assert q.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert flat(log) == sorted(want, key=repr)
    assert {(r["author"], r["seq"]) for r in chain.open_gaps(log).collect()} == set(gaps)
    ok = next(w for w in want if w[3] == "accepted")
    heads = spark.createDataFrame([("w", 1, "a0", 3, "never"), ("w", 2, ok[0], ok[1], ok[2]), ("w", 2, "a1", 99, "never")], "workspace string, epoch int, author string, seq long, event string")
    later = spark.createDataFrame([("w", "a2", 7, True), ("w", "a2", 8, False)], "workspace string, author string, seq long, required boolean")
    faults = {(r["author"], r["seq"], r["fault"]) for r in chain.history_faults(log, heads, 2, later).collect()}
    assert faults == {(a, s, "gap") for a, s in gaps} | {("a1", 99, "boundary"), ("a2", 7, "unsupported")}
    assert log.select(F.count_if(F.col("status") == "accepted")).first()[0] == sum(w[3] == "accepted" for w in want)


def test_recorded_replies_are_read_once_and_listed_by_ranges(spark, tmp_path, monkeypatch):
    rows = [(str(k), 1000.0 - k // 3 if k % 50 else None) for k in range(9000)]
    items = spark.createDataFrame([(i, t, f"title {i}", json.dumps({"of": i, "pad": "x" * 50})) for i, t in rows], "id string, update_time double, title string, detail string")
    monkeypatch.setattr(table_transport, "GROUP", 1 << 14)
    table_transport.record(table_transport.replies(items), str(tmp_path / "replies"))
    t = table_transport.make({"replies": str(tmp_path / "replies")})
    assert len(t.groups) > 20
    read, bodies = [], t._bodies
    monkeypatch.setattr(t, "_bodies", lambda g: (g in t.held or read.append(g)) and None or bodies(g))
    got = list(paged.offset_pages(client(t), "", lambda page: False))
    newest = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(i.id, i.updated) for i in got] == [(i, paged.moment(x)) for i, x in newest]
    assert len(read) <= len(t.groups)  # pages by number, not a search of the whole table each
    read.clear()
    for i in sorted(got, key=lambda i: (len(i.url), i.url)):
        assert json.loads(t.get(i.url)[2])["of"] == i.id
    assert len(read) <= len(t.groups) and t.get("/backend-api/conversation/none")[0] == 404
    # a service without items has an empty first page
    table_transport.record(table_transport.replies(items.limit(0)), str(tmp_path / "none"))
    assert list(paged.offset_pages(client(table_transport.make({"replies": str(tmp_path / "none")})), "", lambda page: False)) == []


class Kept:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.maps, self.asked = {}, 0

    def getMapState(self, name, key, value):
        store, kept = self, self.maps.setdefault(name, {})

        class Map:
            def __getattribute__(self, what):
                store.asked += 1
                return {"exists": lambda: bool(kept), "containsKey": kept.__contains__, "getValue": kept.get, "updateValue": kept.__setitem__, "removeKey": kept.pop}[what]

        return Map()


def test_chain_asks_its_state_by_blocks():
    r, events = random.Random(8), []
    for s in range(1, 601):
        parents = ["elsewhere"] if r.random() < 0.1 else [f"e{s - 1}"] if s > 1 else []
        if r.random() > 0.1:
            events.append(("a", s, f"e{s}", parents))
        if r.random() < 0.15:
            events.append(("a", s, r.choice([f"e{s}", f"o{s}"]), parents))
    r.shuffle(events)
    want, gaps = told(events)
    assert {w[3] for w in want} == {"accepted", "repeated", "replay", "broken"} and gaps
    store, got, half = Kept(), [], len(events) // 2
    for part in (range(half), range(half, len(events))):
        c = chain.Chain()
        c.init(store)
        frames = [pd.DataFrame([(k, *events[k][1:]) for k in part[i::3]], columns=["arrived", "seq", "event", "parents"]) for i in range(3)]
        got += [(t.author, t.seq, t.event, t.status, t.gap, None if pd.isna(t.fills) else t.fills) for f in c.handleInputRows(("w", "a"), iter(frames), None) for t in f.itertuples()]
    assert got == want
    assert store.asked < 40  # not several times an event
