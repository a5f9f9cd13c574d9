"""Operators 11 to 13 against brute force, on several shards, hot keys and edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import lines, middle, prefixes

TURNS = "conv_id long, turn long, role string, text string, depth string, path int"


def conversations():
    rng = random.Random(11)
    rows = []
    for c in range(300):
        for t in range(rng.choice([1, 2, 3, 4, 6, 12])):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bé", "", None, "long " * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]  # a hot conversation
    rows += [(2000, t, "user", f"deep {t}") for t in range(700)]
    rows += [(2003, None, "user", "first"), (2003, None, "user", "first"), (2003, 5, "x", "y"), (2003, 5, "x", "y"), (2003, 5, "w", "y")]
    rows += [(None, 0, "user", "nobody"), (-7, 0, "user", "minus"), (4_000_000_004, 0, "user", "alone")]
    rng.shuffle(rows)
    return rows


def key(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[:16]


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, key((role or "", text or "")), len((text or "").encode()), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        seqs[c] = own.get(base, [])[:h] + t[h:] if rebuild else t
    members, children = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            p = tuple((x[2], x[3]) for x in s[:d])
            members[p].append(c)
            if d:
                children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p)).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()}


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in conversations()], TURNS).cache()


@pytest.mark.parametrize("shard_turns", [60, 500, 10**6])
def test_trie(spark, turns, shard_turns):
    got = [tuple(r) for r in prefixes.conversation_trie(turns, shard_turns).collect()]
    want = brute_trie(conversations())
    assert len(got) == len(want) and set(got) == want


def test_trie_without_rebuilding_and_with_a_small_skeleton(turns):
    seqs = prefixes.sequences(turns)
    for skeleton in (40, 2000):
        assert {tuple(r) for r in prefixes.prefix_trie(seqs, 50, skeleton).collect()} == brute_trie(conversations(), False)


def test_hot_paths_spread_over_shards(spark, turns):
    seqs = prefixes.sequences(turns).cache()
    cuts = prefixes.splitters(seqs, 60, 1 << 20)
    hot = [c for p, c in cuts if len(p) == 48]
    assert len(hot) > 5 and len(set(cuts)) == len(cuts)
    own = prefixes.owners([p for p, _ in cuts])
    names = {}
    for (p, _), o in zip(cuts, own):
        for d, x in enumerate(o):
            assert names.setdefault(p[: 16 * d], (x, d)) == (x, d)
    assert len(set(names.values())) == len(names)


def test_trie_of_nothing(spark):
    assert prefixes.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixes.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], TURNS)).count() == 0


DOCS = "doc_id long, text string, n long, kept string, bitmap string, _h1 long, text_key int"


def documents():
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(["sun", "été", "ROOT", "x", "日本語", "🙂"]) for _ in range(n))
    common = "The common LINE of all"
    texts = [None, "", "\n", "\n\n\n", common, f"  {common.lower()}\t\r", f"{common}\n{common}\nx", "short\nshort", "a line of its own\n\nshort\n" + common, "<P> has a marker", "ends in <", "<S", "\x0b\x0ctwelve chars\r\n"]
    texts += ["\n".join([common] * 5 + [said(6)] + [common] * 3 + ["tail line number one"] * 2)] * 3
    texts += ["\n".join(rng.choice([common, said(1), said(5), "Äquator line ÄÖ", "äquator line äö", "twelve chars"]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts += ["\n".join(f"very long text {i % 5000}" for i in range(20_000)), "y" * 300_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[3], rows[3], (None, f"{common}\nonly here, without id"), (None, f"only here, without id\n{common}"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", "b", 2, 3) for r in documents()], DOCS).repartition(7).cache()


def brute_lines(rows, least=10):
    white, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda x: x.strip(white).translate(lower)
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(of(x)) >= least:
                first[of(x)] = min(first.get(of(x), d), d, key=order)
    out = Counter()
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(of(x)) < least or first[of(x)] == d]
        out[d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("heavy", [None, 20, 1])
def test_line_dedup(docs, heavy):
    done = lines.without_repeated_lines(docs, heavy=heavy)
    assert Counter(tuple(r) for r in lines.digests(done).collect()) == brute_lines(documents())


def test_bitmaps_are_run_lengths(docs):
    rows = lines.keep_bitmaps(docs).collect()
    assert len({(r["doc_id"], r["text_key"]) for r in rows}) == len(rows)
    for r in rows:
        lengths = np.frombuffer(bytes(r["bitmap"]), ">i4").reshape(-1, 2)
        assert lengths[:, 1].sum() == r["n_dropped"] and (lengths[:, 1] > 0).all() and (lengths[1:, 0] > 0).all()


def test_line_dedup_stays_in_the_jvm_and_orders_by_range(docs):
    plan = lines.digests(lines.without_repeated_lines(docs))._jdf.queryExecution().toString()
    assert "rangepartitioning(h1" in plan and not re.search("Python|Pandas|InArrow", plan)


def test_line_dedup_of_nothing(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def brute_middle(rows, seed=1):
    out = Counter()
    for d, t in rows:
        t, n = t or "", len(t or "")
        x = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
        h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            made = n, "plain", None, None, t
        elif h[3] % 100 < 20:
            made = n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
        else:
            made = n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
        out[(d, *made[:4], hashlib.sha256(made[4].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_fill_in_middle(docs):
    got = Counter(tuple(r) for r in middle.digests(middle.transformed(docs)).collect())
    assert got == brute_middle(documents())
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_by_words(docs):
    unit = r"\S+\s*"
    for r in middle.transformed(docs, unit=unit).withColumn("back", middle.restored()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if r["text"] is not None:
            assert r["back"] == r["text"]
            if r["form"] != "plain":
                ends = {0, len(r["text"]), *(m.end() for m in re.finditer(unit, r["text"]))}
                assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= ends


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 400, 5000):
        widths = rng.integers(1, 9, n)
        lanes, ends = middle.SkipList(widths, n), np.concatenate(([0], np.cumsum(widths)))
        assert [lanes.place(r) for r in range(n + 1)] == ends.tolist()
        assert n < 400 or len(lanes.lanes) > 1


def test_fill_in_middle_of_nothing(spark):
    assert middle.digests(middle.transformed(spark.createDataFrame([], DOCS))).count() == 0
