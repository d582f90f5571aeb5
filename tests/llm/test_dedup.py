import hashlib
import random
from collections import Counter, defaultdict

import odd
import pytest
from conftest import same_as_duck
from opalgrid.llm import components, exact_dedup, near_dup, registry, store
from opalgrid.llm.components import connected_components


def groups_of(rows):
    out = defaultdict(list)
    for i, t, *_ in rows:
        out[t or ""].append(i)
    return out


def test_exact_dedup_of_odd_rows(spark):
    docs = odd.documents(spark)
    out = exact_dedup.exact_dedup(docs)
    assert [c for c in out.columns if c not in exact_dedup.OUTPUT] == [c for c in docs.columns if c not in exact_dedup.OUTPUT]
    rows = out.collect()
    assert len(rows) == len(odd.ROWS) and all(r["_key"].startswith("mine") for r in rows)
    want = groups_of(odd.ROWS)
    kept = Counter()
    for r in rows:
        ids = want[r.text or ""]
        largest = max([i for i in ids if i is not None], default=None)
        assert r.group_size == len(ids) and r.keep_id == largest
        assert not r.kept or r.doc_id == largest
        kept[r.text or ""] += r.kept
    assert set(kept.values()) == {1} and set(kept) == set(want)
    assert exact_dedup.deduplicated(docs).count() == len(want)


def test_exact_dedup_of_prefixes_and_repeated_ids(spark):
    same = "p" * 400
    rows = [(1, same + "a", "", ""), (1, same + "b", "", ""), (2, same + "a", "", ""), (3, same + "b", "", ""), (4, same + "c", "", "")]
    out = {(r.doc_id, r.text[-1]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd.documents(spark, rows)).collect()}
    assert out == {(1, "a"): (2, 2, False), (1, "b"): (3, 2, False), (2, "a"): (2, 2, True), (3, "b"): (3, 2, True), (4, "c"): (4, 1, True)}


def test_rows_that_repeat_id_and_text(spark):
    """Of rows that differ elsewhere always the same stays, of rows alike in all columns one; null ids with many texts of one length too."""
    rows = [(5, "same", f"l{i % 3}", "s") for i in range(60)] + [(7, "other", "l", "s")] * 50 + [(None, f"text {i % 40:03d}", "l", str(i % 2)) for i in range(160)]
    seen = set()
    for parts in (1, 7):
        docs = odd.documents(spark, rows).repartition(parts)
        kept = exact_dedup.exact_dedup(docs).where("kept").collect()
        assert len(kept) == 42 and {(r.doc_id, r.text, r.group_size) for r in kept} == {(5, "same", 60), (7, "other", 50)} | {(None, f"text {i:03d}", 4) for i in range(40)}
        seen.add(tuple(sorted(str((r.doc_id, r.text, r.lang, r.source)) for r in kept)))
    assert len(seen) == 1


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 8)
    rows = [(i, f"text {i % 170:04d}" + "x" * (i % 5), "", "") for i in range(400)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(odd.documents(spark, rows)).collect()}
    want = groups_of(rows)
    assert got == {i: (max(want[t]), len(want[t])) for i, t, *_ in rows}


def test_names_of_columns_stay(spark):
    docs = odd.clashing(spark)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns and all(r["kept"].startswith("kept of") and r["a.b"].startswith("a.b of") for r in out.collect())
    assert exact_dedup.exact_dedup(docs.withColumnsRenamed({"doc_id": "d.i", "text": "t`x"}), "d.i", "t`x").where("kept").count() == out.count()


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(odd.empty(spark)).count() == 0


def test_exact_dedup_equals_sql_and_is_native(spark, tiny, duck):
    out = registry.queries()["op4_exact_dedup"](spark, tiny)
    assert same_as_duck(out, duck, registry.oracle_sql()["op4_exact_dedup"]) == 200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def shingle_set(text):
    words, word = [], []
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append("".join(word))
            word = []
        else:
            word.append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_force(rows):
    """{id: (size, least id reachable)} by comparing every two rows."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def variants(seed, n):
    """Texts with copies edited more and more, in chains."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 10):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 6, 8, 20, 60, 200]))]
        for _ in range(10):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([15, 25, 40]))):
                words[rng.randrange(len(words))] = f"W{rng.randrange(3000)}"
    rng.shuffle(texts)
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = variants(seed, 400)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd.documents(spark, rows)).collect())
    assert got == brute_force(rows)


def test_near_duplicates_in_blocks_equal_brute_force(spark, monkeypatch):
    """A family larger than two blocks, with copies of copies."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd.documents(spark, rows)).collect())
    assert got == brute_force(rows)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd.documents(spark)
    rows = near_dup.near_duplicates(docs).collect()
    want = Counter(str((i, n, c)) for i, n, c in brute_force([r for r in odd.ROWS if r[1] != odd.LONG and r[1] != odd.LONG + " end"]))
    got = Counter(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows if r.n_shingles < 50_000)
    # rows without words are linked with nothing, whatever their ids
    assert got == want
    long = sorted((r.doc_id, r.component_id) for r in rows if r.n_shingles > 50_000)
    assert long == [(10, 10), (11, 10)]
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == Counter([1, 3, 4, 5, 6, 6, 7, 10, 12, 13, 14, None, None, None])
    assert near_dup.near_duplicates(odd.empty(spark)).count() == 0
    assert near_dup.without_near_duplicates(odd.empty(spark)).count() == 0


def test_repeated_and_null_ids_lose_no_links(spark):
    """Ids that stand for several texts, and rows without ids, against every two rows compared."""
    rows = variants(3, 200)
    rng = random.Random(2)
    rows = [(rng.choice([None, i % 23, i]), t, "en", "s") for i, t, *_ in rows]
    docs = odd.documents(spark, rows)
    got = Counter(str((r.doc_id, r.n_shingles, r.component_id)) for r in near_dup.near_duplicates(docs).collect())
    want = brute_force(rows)
    assert got == Counter(str(x) for x in want)
    kept = Counter(str((r.doc_id, r.text)) for r in near_dup.without_near_duplicates(docs).collect())
    assert kept == Counter(str((r[0], r[1])) for r, (i, _, c) in zip(rows, want, strict=True) if i == c)


def test_estimates_are_near_the_truth():
    rng = random.Random(3)
    hashes = near_dup.WordHashes()
    base = [f"q{i}" for i in range(400)]
    for share in (0.0, 0.05, 0.3):
        other = [w if rng.random() > share else f"z{rng.random()}" for w in base]
        a, b = (near_dup.shingles(" ".join(x), hashes) for x in (base, other))
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        bits = near_dup.planes([near_dup.low_bits(near_dup.minima(x)) for x in (a, b)])
        assert abs(near_dup.estimates(bits[0], bits[1:])[0] - true) < 0.15


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)] + [(9, 9), (7777, 7777)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links + [(None, 4)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, most):
    """A long chain dealt at random, stars, lone nodes and repeated links; where links are few, no round of joins is run."""
    monkeypatch.setattr(components, "AT_ONCE", most)
    rng = random.Random(11)
    order = rng.sample(range(-500, 500), 1000)
    links = list(zip(order, order[1:], strict=False)) + [(2000, 2000 + i) for i in range(300)] * 2 + [(3000 + i, 3000 + i) for i in range(9)] + [(2000, 2000), (None, 1), (4000, None)]
    rng.shuffle(links)
    frame, before = spark.createDataFrame(links, "a long, b long").repartition(7), len(store._made)
    got = sorted((r.node, r.component) for r in connected_components(frame).collect())
    assert got == [(i, -500) for i in range(-500, 500)] + [(2000 + i, 2000) for i in range(300)] + [(3000 + i, 3000 + i) for i in range(9)]
    assert most == 0 or len(store._made) == before + 1


def test_forests_come_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(components, "AT_ONCE", 5)
    table = pa.table({"a": pa.array(range(1, 21), pa.int64()), "b": pa.array(range(20), pa.int64())})
    parts = list(components._forest(iter(table.to_batches(max_chunksize=2))))
    assert [x.to_pydict() for x in parts[:1]] == [{"u": list(range(7)), "v": [0] * 7}] and sum(x.num_rows for x in parts) == 20 + len(parts)
    assert list(components._forest(iter([]))) == []


def test_forests_that_tasks_left_are_joined(spark, monkeypatch):
    links = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 8)]
    forests = spark.createDataFrame(links[:3], "a long, b long").coalesce(1).unionByName(spark.createDataFrame(links[3:], "a long, b long").coalesce(1))
    forests = forests.mapInArrow(components._forest, "u long, v long").toDF("a", "b")
    for most in (0, 1000):
        monkeypatch.setattr(components, "AT_ONCE", most)
        got = sorted((r.node, r.component) for r in connected_components(forests, forests=True).collect())
        assert got == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 3), (9, 3)]


def _python_steps(plan):
    """The most Python steps that a task of a plan runs at once, each in a worker of its own."""
    most, above = 0, []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        above = [(d, n) for d, n in above if d < depth]
        if name.startswith(("Exchange", "BroadcastExchange", "AdaptiveSparkPlan")):
            above.append((depth, 0))
        else:
            above.append((depth, (above[-1][1] if above else 0) + name.startswith("MapInArrow")))
        most = max(most, above[-1][1])
    return most


def test_near_duplicates_take_one_python_worker_a_task(spark, monkeypatch):
    plans = []

    def kept(df, tag, f=store.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, tag)

    for module in (near_dup, components):
        monkeypatch.setattr(module, "materialize", kept)
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 50 + i])) for i in range(8)] + [(100 + i, " ".join(f"{i}-{j}" for j in range(20))) for i in range(4)]
    out = near_dup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.doc_id for r in out.collect()) == [0, 100, 101, 102, 103]
    assert sum("MapInArrow" in p for p in plans) >= 5 and max(map(_python_steps, plans)) == 1


def test_digest_column(spark, tiny):
    rows = registry.queries()["op4_exact_dedup"](spark, tiny).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("block, wide, largest", [(8, 20, 20_000), (40, 30, 10)])
def test_near_duplicates_with_large_families_and_hot_buckets(spark, monkeypatch, block, wide, largest):
    """Families over many blocks, and band keys that count as hot: no link is lost."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "WIDE_BLOCK", wide)
    monkeypatch.setattr(near_dup, "LARGEST_BUCKET", largest)
    rng = random.Random(8)
    rows = variants(4, 100)
    base = [f"b{i}" for i in range(60)]
    for i in range(220):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words), "en", "s"))
    # families of several clusters, with pairs a little above and below the threshold
    for i in range(120):
        words = [f"c{k}" for k in range(60)]
        at = 6 * (i % 5)
        words[at : at + 4 + i % 3] = [f"d{i % 5}{k}" for k in range(4 + i % 3)]
        words[40 + i % 7] = f"e{i}"
        rows.append((2000 + i, " ".join(words), "en", "s"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd.documents(spark, rows)).collect())
    assert got == brute_force(rows)


def test_long_runs_come_in_linked_parts(monkeypatch):
    import pyarrow as pa

    keys = [1, 2, 2] + [3] * 57 + [4, 5, 5, 5]
    rng = random.Random(1)
    bits = [rng.randbytes(2 * near_dup.MINIMA // 8) for _ in keys]
    bits[1] = bits[2]
    table = pa.table({"key": pa.array(keys, pa.int64()), "id": pa.array(range(len(keys)), pa.int64()), "bits": pa.array(bits, pa.binary())})
    monkeypatch.setattr(near_dup, "LARGEST_BUCKET", 10)
    for size in (1, 4, 7, 64):
        links = [(a, b) for x in near_dup._bucket_links(iter(table.to_batches(max_chunksize=size))) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
        assert (1, 2) in links and not any(a > 59 or b > 59 for a, b in links)
        reach = {3}
        for _ in range(60):
            reach |= {x for link in links if set(link) & reach for x in link}
        assert reach == set(range(3, 60))


@pytest.mark.parametrize("name", ["op9_near_duplicates", "imatch_edits", "pii_base_counts", "mixing_targets"])
def test_queries_equal_their_sql(spark, name):
    from pathlib import Path

    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    assert same_as_duck(registry.queries()[name](spark, folder), con, registry.oracle_sql()[name]) == 1000
