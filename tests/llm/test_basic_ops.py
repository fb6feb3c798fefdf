"""Sharding, exact dedup, quality rules and mixing against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prefscope.llm import exact_dedup, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, bucket string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "k", "b") for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é#", "ß$", "|"]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 19, 20, 21, 60, 200]))]
        if i % 5 == 0:
            words += words[:30]
        rows.append([i, r.choice([" ", "\n", "\t", " \n"]).join(words), f"s{i % 4}" if i % 3 else "s0"])
    for i in range(0, 40, 2):  # a large group of copies
        rows[i][1] = rows[0][1] or "again and again"
    rows[3][1], rows[5][1], rows[7][2], rows[9][1] = None, "", None, "x" * 50_000 + " tail\n" * 30
    rows += [[11, rows[11][1], rows[11][2]], [None, "no id", "s1"], [n, "\n\nlast", "s9"], [n + 1, "", "s9"]]
    return [tuple(x) for x in rows]


def empty(spark):
    return table(spark, []).limit(0)


def test_best_fit_decreasing_is_the_packing_item_by_item():
    r = random.Random(3)
    for _ in range(30):
        items = sorted((r.randint(1, 40) for _ in range(r.randint(1, 60))), reverse=True)
        capacity, room, want = 50, [], []
        for s in items:
            fits = [(free, b) for b, free in enumerate(room) if free >= s]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(capacity)
            room[b] -= s
            want.append((s, b))
        sizes = sorted(Counter(items).items(), reverse=True)
        plan, n = sharding.best_fit_decreasing(sizes, capacity)
        got = [(s, b) for (s, _), parts in zip(sizes, plan) for k, b in parts for _ in range(k)]
        assert sorted(got) == sorted(want) and n == len(room)


def test_tree_of_room_takes_the_tightest(monkeypatch):
    monkeypatch.setattr(sharding.RoomTree, "WIDTH", 3)
    r = random.Random(8)
    tree, held = sharding.RoomTree(), []
    for i in range(5000):
        if r.random() < (0.6 if i < 2500 else 0.4):
            pair = (r.randint(0, 300), i)
            tree.put(pair)
            held.append(pair)
        else:
            low = (r.randint(0, 320), -1)
            want = min((p for p in held if p >= low), default=None)
            assert tree.take(low) == want
            if want:
                held.remove(want)
    assert [tree.take((0, -1)) for _ in range(len(held) + 1)] == sorted(held) + [None]


def test_sharding(spark):
    rows = corpus()
    got = sharding.shard_documents(table(spark, rows), bins=6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[by_id[r.doc_id]].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())
    assert set(slots) <= set(range(6))
    again = sharding.shard_documents(table(spark, rows).repartition(5), bins=6)
    assert Counter((r.doc_id, r.shard) for r in again.collect()) == Counter((r.doc_id, r.shard) for r in got)


def test_sharding_by_capacity(spark):
    got = sharding.shard_documents(table(spark, corpus()), bins=None, capacity=3000)
    for r in got.groupBy("shard").agg(F.sum("size").alias("s"), F.max("group_bytes").alias("g")).collect():
        assert r.s <= 3000 or r.s == r.g
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_sharding_writes_few_files(spark, monkeypatch):
    # Each file costs processes on the executor; a shuffle may have far more partitions than cores.
    files, write = {}, sharding.written

    def counted(df, name, *parts):
        out = write(df, name, *parts)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(sharding, "written", counted)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    want = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(table(spark, corpus()), bins=6).collect()}
    try:
        for k, v in zip(keep, ("40", "false")):
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(table(spark, corpus()), bins=6).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == want
    assert max(files[f"shard-{x}"] for x in ("groups", "plan", "assigned")) <= spark.sparkContext.defaultParallelism


def test_sharding_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("prefscope.llm.shared.ROWS_PER_BUCKET", 7)
    got = sharding.shard_documents(table(spark, corpus()), bins=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("bucket_keys", [1, 3, 100_000])
def test_exact_dedup(spark, bucket_keys):
    rows = corpus()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = Counter()
    for i, t, _ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(table(spark, rows), bucket_keys).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == want
    one = exact_dedup.unique_documents(table(spark, rows), bucket_keys)
    assert one.columns == table(spark, rows).columns
    assert Counter((r.text or "") for r in one.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_groups(empty(spark)).collect() == []


def test_directory_doubles_and_chains_equal_keys(spark):
    keys = spark.createDataFrame([(i << 52,) for i in range(-40, 40)] + [(5,), (6,), (7,)], "key long")
    buckets = exact_dedup.directory(keys, 2)
    held = exact_dedup.bucket_of(keys, buckets)
    assert held.where("bucket is null").count() == 0
    assert held.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2
    assert len({d for d, _ in buckets}) > 1


def test_texts_with_one_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "text_key", lambda text: F.length(text).cast("long"))
    rows = [(1, "ab", "s"), (2, "ba", "s"), (3, "ab", "s"), (4, "abc", "s")]
    got = exact_dedup.exact_groups(table(spark, rows), 1).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 3, 3: 3, 2: 2, 4: 4}


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= set(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def test_quality_measures(spark):
    rows = corpus()
    got = quality.judge(table(spark, rows)).collect()
    want = Counter((i, *plain_measures(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == want
    assert quality.judge(empty(spark)).collect() == []


def test_host_verdict_reaches_passing_documents(spark):
    good = " ".join(f"g{i}" for i in range(30))
    rows = [(i, "short", "bad") for i in range(50)] + [(50, good, "bad")]
    rows += [(100 + i, good, f"h{i % 5}") for i in range(200)] + [(400, "short", "tiny"), (401, good, "tiny")]
    got = {r.doc_id: r for r in quality.judge(table(spark, rows)).collect()}
    assert not got[50].base_failed and not got[50].kept
    assert all(got[100 + i].kept for i in range(200))
    n, f = Counter(), Counter()
    for i, t, s in rows:
        n[s] += 1
        f[s] += got[i].base_failed
    N, k, m = sum(n.values()), len(n), sum(f.values()) / sum(n.values())
    S = sum(n[s] * (f[s] / n[s] - m) ** 2 for s in n)
    t = (S - (k - 1) * m * (1 - m)) / (N - sum(v * v for v in n.values()) / N - (k - 1))
    strength = max(0.0, m * (1 - m) / t - 1)
    for i, _, s in rows:
        assert math.isclose(got[i].host_rate, (f[s] + strength * m) / (n[s] + strength), rel_tol=1e-9)


def plain_mix(rows, seed=17):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * total[s]}
        if not above:
            break
        capped |= above
    taken = Counter()
    for s in order:
        epochs = min(3, int(target[s] // total[s])) if total[s] else 0
        keyed = []
        for (i, t, source), n in zip(rows, size):
            if source == s:
                u = (int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + .5) / 2**52
                w = WORD.findall(t or "")
                keyed.append((-math.log(u) / (len(set(w)) / n if n else 1.0), i, n))
        start = 0
        for _, i, n in sorted(keyed, key=lambda x: (x[0], -1 if x[1] is None else x[1])):
            more = target[s] - epochs * total[s] - start >= n / 2
            taken[i] += n * (epochs + more)
            start += n
    return target, taken


def test_mixing(spark):
    rows = corpus(5, 300)
    target, taken = plain_mix(rows)
    got = mixing.mix_report(table(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    found = Counter()
    for r in got:
        found[r.doc_id] += r.taken
        assert math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9)
        assert r.taken <= 3 * r.size
    assert +found == +taken
    mixed = mixing.mix(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert +words == +taken
    assert mixing.mix_report(empty(spark)).collect() == [] and mixing.mix(empty(spark)).collect() == []
    none = mixing.mix_report(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in none) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_lookup_spreads_a_hot_key(spark):
    """Rows of a heavy key are matched by broadcast and don't meet in the
    shuffle join; all rows come back once."""
    from prefscope.llm.shared import lookup, written
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 10).alias("k"))
    table_ = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v")), "test-lookup")
    found = lookup(rows, table_, ["k"], "n", ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "_cold_salt" in plan
    want = rows.join(table_, "k").select("id", "k", "n", "v")
    assert found.count() == 20_000 and found.exceptAll(want).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup(rows, table_, ["k"], "n", ["id"])
        joined = found._jdf.queryExecution().executedPlan().toString()
        exchange = [x for x in joined.split("\n") if "hashpartitioning(" in x]
        assert any("_salt" in x for x in exchange), joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_written_tables_have_small_row_groups(spark):
    """A task that writes texts holds one row group of them in memory."""
    import glob

    import pyarrow.parquet as pq
    from prefscope.llm import shared
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(40)])
    table = shared.written(spark.range(0, 16_000, 1, 1).select("id", text.alias("text")), "row-groups")
    sizes = []
    for f in table.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        sizes += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 70e6 and max(sizes) < 1.3 * shared.ROW_GROUP_BYTES
    assert table.count() == 16_000
