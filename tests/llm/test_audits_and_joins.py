"""Filter audit, source divergence and the n-gram Jaccard join against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import filter_audit, jaccard_join, signature_tree, source_divergence
from tests.llm.test_operators import ODD, SCHEMA, empty, odd, words  # noqa: F401


# ---- filter audit


def brute_audit(rows, letters="ABCDE"):
    """rows: (part, failed letters, good, toxic); all steps of all orders, one by one."""
    out = []
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        removed_by = Counter()
        steps = []
        for order in permutations(letters):
            left = list(own)
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed_by[x] += len(removed)
                fails = [r for r in own if x in r[1]]
                steps.append((part, "".join(order), step, len(left), len(removed), len(fails) - len(removed),
                              sum(r[1] == {x} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed), x))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(out)


def brute_failures(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t, w = t or "", words(t)
        failed = {x for x, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t),
            i is not None and i > first[t])) if bad}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((part or "", failed, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    return rows


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (5, 1, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)]


def test_audit_of_odd_rows(spark, odd):  # noqa: F811
    many = " ".join(f"w{i}" for i in range(250))
    more = [(20, many, "a"), (21, many, "a"), (22, many + " $", "b"), (23, many.upper(), None), (None, many, "a"), (20, many, "c")]
    docs = odd.select("doc_id", "text", "source", "row", "score").union(
        spark.createDataFrame([(*r, "x", 0.5) for r in more], "doc_id long, text string, source string, row string, score double"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("source", F.lit("clash"))
    got = filter_audit.audit(filter_audit.failures(docs, labels)).collect()
    assert sorted(map(tuple, got)) == brute_audit(brute_failures([tuple(r)[:3] for r in docs.collect()], LABELS))


def test_audit_of_random_counts(spark):
    rng = random.Random(3)
    cells = [(p, m, rng.randint(0, 9), rng.randint(0, 5), rng.randint(0, 3)) for p in ("", "x") for m in range(8) if rng.random() < 0.8]
    counts = spark.createDataFrame(cells, "part string, fails int, n long, good long, toxic long")
    rows = [(p, f, *gt) for p, m, n, g, t in cells for f in [{x for i, x in enumerate("ABC") if m >> i & 1}] for gt in
            [(k < min(g, n), k < min(t, n)) for k in range(n)]]
    counts = counts.withColumns({"good": F.least("good", "n"), "toxic": F.least("toxic", "n")})
    assert sorted(map(tuple, filter_audit.audit(counts, "ABC").collect())) == brute_audit(rows, "ABC")


def test_potentials_share_out_the_game(spark):
    """What the filters of a coalition get, P(S) - P(S without i) each, adds up to its value."""
    counts = spark.createDataFrame([("", m, m * m % 11 + 1, 0, 0) for m in range(32)], "part string, fails int, n long, good long, toxic long")
    r = filter_audit.removal_games(counts, 5, ["n"]).withColumn("p", filter_audit.potential("v_n", 5)).first()
    for s in range(32):
        assert sum(r["p"][s] - r["p"][s & ~(1 << i)] for i in range(5) if s >> i & 1) == 120 * r["v_n"][s]


def test_audit_of_no_rows(spark, empty):  # noqa: F811
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(empty, labels)).count() == 0
    no_labels = filter_audit.failures(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), labels.limit(0))
    assert [tuple(r) for r in no_labels.collect()] == [("s", 1, 1, 0, 0)]


# ---- source divergence


def brute_divergence(docs, min_docs, top):
    """docs: (text, lang, source); all terms of all pairs, with Python's whole numbers."""
    seen, times = defaultdict(Counter), defaultdict(Counter)
    groups = {(la or "", s or "") for _, la, s in docs}
    for t, la, s in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        seen[la or ""].update(set(terms))
        times[la or "", s or ""].update(terms)
    out = []
    for la in {g[0] for g in groups}:
        kept = [t for t, n in seen[la].items() if n >= min_docs]
        own = [s for x, s in groups if x == la]
        v = len(kept)
        total = {s: sum(times[la, s][t] for t in kept) for s in own}
        p = lambda n, all_n: 1 + 10**9 * (n + 2) // (all_n + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            far = [(sum(f(p(times[la, s][t], total[s]), p(times[la, o][t], total[o])) for t in kept), o) for o in own if o != s]
            terms = []
            for t in kept:
                a, b = p(times[la, s][t], total[s]), p(sum(times[la, o][t] for o in own), sum(total.values()))
                if times[la, s][t] and a > b:
                    terms.append((f(a, b), t))
            for part, rows, last in (("pair", far, len(far)), ("term", terms, top)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(la, s, part, item, value, i) for i, (value, item) in enumerate(rows[:last], 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [600_000, 5])
def test_divergence_equals_brute_force(spark, odd, held, monkeypatch):  # noqa: F811
    monkeypatch.setattr(source_divergence, "HELD", held)
    rng = random.Random(5)
    vocabulary = ["ab", "Cd", "é", "日本", "x", "longer", "the", "of", "\U0001F600", "zz"]
    docs = [(" ,1-".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None, "big", "big"]))
            for _ in range(60)]
    docs += [(t, la, s) for _, t, la, s, _ in ODD] + [("1 2 3", "xx", "a"), (None, "xx", "b"), ("only one", "yy", "a")]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "text string, lang string, source string, value long, item string").repartition(3)
    for min_docs in (1, 3):
        got = source_divergence.divergence(df, min_docs=min_docs, top=4).collect()
        assert sorted(map(tuple, got)) == brute_divergence(docs, min_docs, 4)


def test_divergence_of_no_rows(empty):  # noqa: F811
    assert source_divergence.divergence(empty).count() == 0


def test_tree_walk_equals_single_rows():
    rng = np.random.default_rng(2)
    o = rng.integers(1, 50, 6)
    rows = []
    for _ in range(300):
        source = np.flatnonzero(rng.random(6) < 0.5)
        count = rng.integers(1, 3, len(source))
        rows.append((list(zip(source.tolist(), count.tolist())), int(rng.integers(1, 4))))
    rows.sort()
    walk, want = source_divergence.Walk(), Counter()
    g = source_divergence.gaps
    for path, times in rows:
        s, c = (np.array([x[k] for x in path], np.int64) for k in (0, 1))
        p = 40 * c + o[s]
        walk.insert(np.stack([s, c, p, o[s]]), times)
        for i, j in combinations(range(len(path)), 2):
            want[s[i], s[j]] += times * int(g(p[i], p[j]) - g(p[i], o[s[j]]) - g(o[s[i]], p[j]) + g(o[s[i]], o[s[j]]))
    walk.leave(0)
    assert {(a, b): v for a, b, v in zip(*walk.pairs())} == dict(want)


# ---- Jaccard join


def shingles_of(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(docs):
    sets = [shingles_of(t) for _, t in docs]
    part = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]) and part[i] != part[j]:
            part = [part[i] if x == part[j] else x for x in part]
    least = {}
    for x, (i, _) in zip(part, docs):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return sorted(((i, len(s), least.get(x)) for (i, _), s, x in zip(docs, sets, part)), key=str)


def copies(rng):
    """Chains of near copies that differ by up to a fifth, a passage in all of them, short texts."""
    docs, passage = [], [f"p{i}" for i in range(30)]
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 90))]
        for _ in range(12):
            if rng.random() < 0.7:
                base = list(base)
                base[rng.randrange(len(base))] = f"v{rng.randrange(10**6)}"
            docs.append(" ".join(passage + base if rng.random() < 0.5 else base))
    docs += ["a b c", "A b  c", "a b c d e", "a b c d", "", " "] * 2
    return list(enumerate(docs))


@pytest.mark.parametrize("block,counters,held", [(2048, 1 << 18, 8192), (4, 32, 7)])
def test_jaccard_join_equals_brute_force(spark, odd, block, counters, held, monkeypatch):  # noqa: F811
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HELD_ROWS", held)
    given = jaccard_join.frequent_shingles
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda docs, text: given(docs, text, counters))
    docs = copies(random.Random(block)) + [(i, t) for i, t, *_ in ODD]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, row string, `part` string").repartition(3)
    got = jaccard_join.join(df).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_join(docs)
    ids = {r["row"]: r["id"] for r in got}
    assert len(ids) == len(docs) and all(ids[r["first_row"]] == r["component_id"] for r in got)


def test_jaccard_join_of_no_rows(spark, empty):  # noqa: F811
    assert jaccard_join.join(empty).count() == 0
    alone = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(alone).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_trees_lose_no_link():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (3, 40, 130, 260)]
    sets, group = [], []
    for _ in range(400):
        b = base[rng.integers(4)]
        keep = b[rng.random(len(b)) < rng.choice([0.7, 0.9, 1])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(1, 12)).astype(np.uint64)])))
        group.append(int(rng.integers(3)))
    group, size = np.array(group), np.array([len(s) for s in sets])
    low = np.array([s[0] for s in sets])
    found = set()
    for i, j in signature_tree.candidate_pairs(group, size, low, [signature_tree.bitmap(s) for s in sets], 4, 5):
        pairs = {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())}
        assert len(pairs) == len(i) and not pairs & found
        found |= pairs
    linked = 0
    for i, j in combinations(range(400), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if group[i] == group[j] and 5 * both >= 4 * (size[i] + size[j] - both):
            linked += 1
            assert (i, j) in found
        assert group[i] == group[j] or (i, j) not in found
    assert linked > 100 and len(found) < 20 * linked


def test_linked_sets_have_a_key_in_common():
    """At the threshold, around the sizes where families of parts begin and with any share of listed shingles."""
    rng = np.random.default_rng(13)
    least, tried = jaccard_join.LONG, 0
    for n in [1, 4, 5, 30] + [x + d for f in range(4) for x in (least << f, (5 * least << f) // 4) for d in (-1, 0, 1)]:
        for _ in range(60):
            more = int(rng.integers(0, n // 4 + 1))
            fewer = (n - 4 * more) // 5
            pool = rng.permutation(np.unique(rng.integers(0, 1 << 64, n + more, dtype=np.uint64)))
            x, y = np.sort(pool[:n]), np.sort(pool[fewer:])
            assert 5 * len(np.intersect1d(x, y)) >= 4 * len(pool)
            listed = np.sort(pool[rng.random(len(pool)) < rng.choice([0, 0.2, 0.3, 0.4, 0.5, 1])])
            place = rng.permutation(len(listed))
            (a, c), (b, d) = (jaccard_join.keys_of(s, listed, place) for s in (x, y))
            assert len(np.intersect1d(a, b)) or len(np.intersect1d(c, d))
            tried += 1
    assert tried > 1500


def test_texts_that_share_phrases_are_no_group(spark, monkeypatch):
    """Single shingles that long texts share by chance send no bitmaps to groups; near copies still meet."""
    rng = random.Random(6)
    phrases = [" ".join(f"p{k}_{i}" for i in range(5)) for k in range(300)]
    docs = []
    for k in range(80):
        parts = [" ".join(f"u{k}_{j}_{i}" for i in range(3)) for j in range(30)]
        docs.append(" ".join(x for pair in zip(rng.sample(phrases, 30), parts) for x in pair))
    docs += [docs[k].replace(f"u{k}_7_1", "new") for k in range(5)]
    docs = list(enumerate(docs))
    sent, given = [], jaccard_join.tree_candidates

    def counted(grouped):
        sent.append(grouped.count())
        return given(grouped)

    monkeypatch.setattr(jaccard_join, "tree_candidates", counted)
    got = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_join(docs)
    assert len({r["component_id"] for r in got}) == 80
    assert 10 <= sent[0] <= 40


def test_frequent_shingles_are_listed(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = [f"{passage} {' '.join(f'u{k}_{i}' for i in range(30))}" for k in range(200)]
    keys, place = jaccard_join.frequent_shingles(spark.createDataFrame([(d,) for d in docs], "text string").repartition(4), "text", 64)
    assert set(jaccard_join.shingle_set(passage).tolist()) <= set(keys.tolist()) and len(keys) <= 64
    assert sorted(place.tolist()) == list(range(len(keys)))
    found = jaccard_join.shingle_set(docs[0])
    other, last = jaccard_join.prefix(found, keys, place)
    assert len(other) == len(found) // 5 + 1 and not len(last) and not set(other.tolist()) & set(keys.tolist())


def test_row_keys_of_a_scan(spark, odd, tmp_path):  # noqa: F811
    """Rows of a scan are named by file and place, also where columns have the helper's names."""
    from corpuslab.llm import common, simhash

    given = odd.withColumn("row_number_", F.lit(7)).withColumn("file_path_", F.lit("x"))
    given.repartition(3).write.parquet(str(tmp_path / "docs"))
    scan = spark.read.parquet(str(tmp_path / "docs"))
    for df in (scan, given):
        keyed, row = common.row_keys(df)
        assert keyed.columns == [*df.columns, row] and row not in df.columns
        assert keyed.select(row).distinct().count() == len(ODD) and sorted(map(str, keyed.drop(row).collect())) == sorted(map(str, df.collect()))
    kept = [simhash.near_dedup(df) for df in (scan, given)]
    assert kept[0].columns == given.columns
    assert sorted(str(r["doc_id"]) for r in kept[0].collect()) == sorted(str(r["doc_id"]) for r in kept[1].collect())
