import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from graphloom.llm import exact_dedup, line_dedup, simhash_dedup
from graphloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, kept string, n_chars long"
EMPTY: list = []


def docs(spark, rows):
    """Documents with an extra column whose name clashes with a result's."""
    return spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in rows], SCHEMA)


ROWS = [(3, "same"), (7, "same"), (1, "other"), (5, None), (6, ""), (None, "same"), (8, "twice"), (8, "twice"), (9, "x" * 50_000), (10, "x" * 50_000 + "y"), (11, "x" * 300 + "a" * 10), (12, "x" * 300 + "b" * 10)]


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_exact_groups(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast_rows)
    got = exact_dedup.exact_groups(docs(spark, ROWS), digest=True).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            want[(i, keep, len(ids), i == keep and ids.index(i) + n >= 0 and sorted(ids, key=lambda x: (x is None, x)).index(i) == n, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_drop_copies_keeps_one_row_each(spark):
    got = exact_dedup.drop_copies(docs(spark, ROWS))
    assert got.columns == ["doc_id", "text", "lang", "kept", "n_chars"]
    assert Counter(r["text"] or "" for r in got.collect()) == Counter({t or "" for _, t in ROWS})
    assert {r["doc_id"] for r in got.collect()} == {7, 1, 6, 8, 9, 10, 11, 12}


def test_exact_on_an_empty_table(spark):
    assert exact_dedup.exact_groups(docs(spark, EMPTY)).count() == 0
    assert exact_dedup.drop_copies(docs(spark, EMPTY)).count() == 0


def plain_lines(rows):
    space, low = " \t\n\x0b\x0c\r", lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)
    own = {}
    key = lambda line: low(line).strip(space)
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if k not in own or rank(i) < rank(own[k]):
                own[k] = i
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or own[key(x)] == i]
        out[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


def test_line_dedup(spark):
    r = random.Random(1)
    pool = ["A common LINE here", "a common line here \t", "short", "", "Éclair une longue ligne", "éclair une longue ligne", "line number one is long", "  line number two is long", "\x0bline number two is long"]
    rows = [(i, "\n".join(r.choice(pool) + ("" if r.random() < 0.7 else str(r.randrange(30))) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(None, "a common line here\nunique to none at all"), (5, rows[5][1]), (5, "another row of five\nline number one is long"), (70, None), (71, ""), (72, "\n".join(["long enough to repeat"] * 3000))]
    for batches in (1, 4, 7):
        got = line_dedup.dedup_lines(docs(spark, rows), batches=batches).collect()
        assert Counter((x["doc_id"], x["kept_text"], x["n_lines"], x["n_dropped"]) for x in got) == plain_lines(rows)
    assert line_dedup.dedup_lines(docs(spark, EMPTY)).count() == 0


def test_line_runs_carry_on_and_compact(spark):
    runs = line_dedup.SortedRuns(spark)
    line_dedup.dedup_lines(docs(spark, [(1, "first long line of all"), (2, "second long line of all")]), runs=runs).collect()
    later = line_dedup.dedup_lines(docs(spark, [(3, "first long line of all\nbrand new line"), (4, "brand new line")]), runs=runs)
    assert {(x["doc_id"], x["kept_text"]) for x in later.collect()} == {(3, "brand new line"), (4, "")}
    assert all(len(level) < runs.fanout for level in runs.levels.values())
    assert runs.all().groupBy("__h1", "__h2").count().where("count > 1").count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É é Ab c d e", "a b c " * 30_000])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


def test_planes_cover_every_three_bytes():
    masks = simhash_dedup._planes()
    kept = [{b for b in range(8) if m >> (8 * b) & 0xFF} for m in masks]
    assert len(masks) == 14 and all(len(k) == 4 for k in kept)
    import itertools

    assert all(any(not k & set(bad) for k in kept) for bad in itertools.combinations(range(8), 3))


def plain_components(values):
    label = list(range(len(values)))
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= 3):
            a, b = label[i], label[int(j)]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("limit", [1024, 16])
def test_links_lose_no_component(spark, limit):
    r = np.random.default_rng(5)
    centre = r.integers(0, 2**64, 6, dtype=np.uint64)
    near = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (120, 4)).astype(np.uint64), axis=1) for c in centre])
    chain = [np.uint64(2**63 + 5)]
    for k in range(20):
        chain.append(chain[-1] ^ np.uint64(7 << (3 * k)))
    values = np.unique(np.concatenate([near, chain, r.integers(0, 2**64, 200, dtype=np.uint64)]))
    unique = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "__fp long")
    labels = {x["node"]: x["label"] for x in connected_components(simhash_dedup.fingerprint_links(unique, limit)).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for v, c in zip(values.view(np.int64).tolist(), plain_components(values)):
        want[c].add(v)
        got[labels.get(v, v)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_simhash_components_and_filter(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(4, text), (2, text + " tail"), (9, text), (1, None), (3, ""), (5, "different words entirely here"), (None, text), (5, "a second row of five altogether")]
    got = {(x["doc_id"], x["fingerprint"]): x["component_id"] for x in simhash_dedup.simhash_components(docs(spark, rows)).collect()}
    assert all(f == f"{plain_fingerprint(t):016x}" for (_, f), t in zip(sorted(got, key=str), [t for _, t in sorted(((i, t) for i, t in rows), key=lambda x: str((x[0], f"{plain_fingerprint(x[1]):016x}")))]))
    assert {c for (i, _), c in got.items() if i in (4, 2, 9, None)} == {2}
    kept = simhash_dedup.drop_near_copies(docs(spark, rows))
    assert sorted((x["doc_id"], x["text"]) for x in kept.collect()) == [(1, None), (2, text + " tail"), (5, "a second row of five altogether"), (5, "different words entirely here")]
    assert simhash_dedup.simhash_components(docs(spark, EMPTY)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (7, 7)]
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 50, 50: 50, 75: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_components(texts):
    prints = [simhash_dedup.fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@pytest.mark.parametrize("most", [500_000, 0])
def test_near_copies_go_whatever_is_sent(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "BROADCAST_ROWS", most)
    r = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(12)]
    texts += [t + " more" for t in texts[:4]] + texts[:3] + ["", None, "one"]
    rows = [(i, t, "a", "b", i) for i, t in enumerate(texts)] + [(2, texts[2], "a", "b", 99), (2, texts[2], "a", "b", 100), (None, "alone without an id " * 5, "a", "b", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, none string, `key` string, `row` long")
    got = simhash_dedup.drop_near_copies(table)
    assert got.columns == table.columns
    kept = [x["doc_id"] for x in got.collect()]
    group = plain_components([t or "" for t in texts])
    assert Counter(kept) == Counter([*{g for g in group}, None])
    assert simhash_dedup.drop_near_copies(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_exact_copies_whatever_is_sent(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    head = "x" * 300
    texts = ["a", "b", "a", head + "1", head + "2", head + "1", None, "", "é", "zz", "longer than others", "same", "same", "same"]
    rows = [(i, t, "l", "s", "f") for i, t in enumerate(texts)] + [(3, head + "1", "l", "s", "f")]
    table = spark.createDataFrame(rows, "doc_id long, text string, __len string, __hit string, __full string")
    last = {}
    for i, t, *_ in rows:
        last[t or ""] = max(i, last.get(t or "", -1))
    n = Counter(t or "" for _, t, *_ in rows)
    got = exact_dedup.exact_groups(table, digest=True).collect()
    import hashlib

    assert Counter((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got) == Counter((i, last[t or ""], n[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert Counter(x["doc_id"] for x in got if x["kept"]) == Counter(last.values())
    out = exact_dedup.drop_copies(table)
    assert out.columns == table.columns and Counter(x["doc_id"] for x in out.collect()) == Counter(last.values())


def test_lines_are_marked_by_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SENT_DOCS", 0)
    test_line_dedup(spark)
