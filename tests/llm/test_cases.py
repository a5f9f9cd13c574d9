"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import ann, apportion, mixing, packing, pii, quality, sharding, simhash, suffixes, tokens, warc, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, fp double, sid int, at string, n_entities int"


def vocabulary(name):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


def edge_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "été", "ñu", "IDEE", "x1", "mail", "sun"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = say(30_000)
    texts = [None, "", " \n\t ", say(5), say(25), say(200), "a\n\nb  c\t d   e", long, long, say(60) + "\n" + say(3) + "\n" + say(3), "same line\nsame line\nother", "ha " * 300, "line one here\n" * 40]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, ["a", "b", None, "a", "b", None, "a", "c", "c", "a", "b", "a", "b"]))]
    rows += [rows[4], rows[4], (None, say(30), "en", "a"), (None, None, "en", None)]
    rows += [(100 + i, say(rng.randint(20, 120)), "en", rng.choice(["a", "b", "c"])) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 1, "k", 0.5, 3, "t", 7) for r in edge_rows()], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(40)] + [(101, 1, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("seats", [1, 7, 50, 1000])
def test_apportionment_is_highest_quotients(spark, seats):
    rng = random.Random(seats)
    weights = {k: rng.choice([0.0, 1.0, 2.0, rng.random() * 100]) for k in range(1, 30)}
    df = spark.createDataFrame([(0, k, w, seats) for k, w in weights.items()], "g int, k long, w double, s long")
    got = {r["k"]: r["won"] for r in apportion.sainte_lague(df, "g", "k", "w", "s", "won").collect()}
    quotients = sorted(((-w / (2 * i + 1), k) for k, w in weights.items() if w for i in range(seats)))[:seats]
    want = Counter(k for _, k in quotients)
    assert got == {k: want.get(k, 0) for k in weights}


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    texts = edge_rows()
    assert len(rows) == len(texts)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(words(t))) for d, t, _, _ in texts)
    size, taken, target = Counter(), Counter(), {}
    for (d, t, _, s) in texts:
        size[s] += len(words(t))
    doc_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        src = next(s for s, n in size.items() if n == r["source_size"])
        taken[src] += r["taken"]
        target[src] = r["target"]
        doc_source.setdefault(r["doc_id"], src)
    total, open_, want = sum(size.values()), {"a": 1.0, "b": 2.0, "c": 3.0, None: 1.0}, {}
    left = float(total)
    while True:
        w = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / w > 3 * size[s]]
        if not over:
            want |= {s: left * x / w for s, x in open_.items()}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            del open_[s]
        left = total - sum(want.values())
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 64 * 3 + 0.05 * want[s]
    again = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0
    odd = mixing.mixed_documents(docs.select("*", F.lit(1).alias("_size"), F.lit(2).alias("_row"), F.lit(3).alias("shard")))
    assert odd.where("_size = 1 and _row = 2 and shard = 3").count() == odd.count() > 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.where("text is null").count() == 0


@pytest.mark.parametrize("weights", [(1.0, 10.0, 3.0), (3.0, 1.0, 2.0)])
def test_mixed_documents_meet_the_targets_with_long_documents(spark, weights):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(400, 2000)), "abc"[i % 20 // 7]) for i in range(1500)]
    rows += [rows[0]] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = spark.createDataFrame(list(zip("abc", weights)), "source string, weight double")
    target = {r["source"]: r["target"] for r in mixing.mix(df, mix).select("source", "target").distinct().collect()}
    kept = mixing.mixed_documents(df, weights=mix).collect()
    size = {(i, s): len(t.split()) for i, t, s in rows}
    for s, want in target.items():
        assert abs(sum(size[r["doc_id"], s] for r in kept if r["source"] == s) - want) < 6000
        whole = sum(size[i, x] for i, _, x in rows if x == s)
        share = sum(r["source"] == s and size[r["doc_id"], s] > 1700 for r in kept) / sum(x == s and size[i, x] > 1700 for i, _, x in rows)
        assert abs(share - want / whole) < 0.15


def base_counts(t):
    w = words(t)
    n = len(w)
    seen = defaultdict(list)
    for i in range(n - 7):
        seen[tuple(w[i : i + 8])].append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, labels):
    rows = quality.score(docs, labels, buckets=1 << 10).collect()
    want = Counter((d, *base_counts(t)) for d, t, _, _ in edge_rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert {r["kept"] for r in rows if not r["base_failed"] and (r["doc_id"] or 0) >= 100} == {True}
    none = quality.score(docs, labels.limit(0), buckets=1 << 10)
    assert none.where("kept = base_failed").count() == 0
    assert quality.score(docs.limit(0), labels, buckets=1 << 10).count() == 0
    odd = docs.select("*", F.lit(1).alias("_ratios"), F.lit(2).alias("_cut"), F.lit(3).alias("_quality"))
    assert quality.kept_documents(odd, labels, buckets=1 << 10).where("_ratios = 1 and _cut = 2 and _quality = 3").count() == sum(r["kept"] for r in rows)
    kept = quality.kept_documents(docs, labels, buckets=1 << 10)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_quality_rejects_what_the_target_never_says(spark):
    rng = random.Random(1)
    good = ["the", "of", "sun", "moon", "river", "stone", "walk", "night"]
    bad = ["zz%%", "qq##", "xx&&", "vv**"]
    rows = [(i, " ".join(rng.choice(good if i % 5 else bad) for _ in range(80))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.score(df, lab, buckets=1 << 12).collect()}
    assert all(got[i] == (i % 5 > 0) for i in got)


def slow_fingerprint(t, n=4):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    fps = {d: slow_fingerprint(t) for d, t, _, _ in edge_rows() if d is not None}
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] for r in rows)
    groups = {d: {e for e in fps if bin(fps[d] ^ fps[e]).count("1") <= 4} for d in fps}
    changed = True
    while changed:
        changed = False
        for d in groups:
            more = set().union(*(groups[e] for e in groups[d]))
            changed |= more != groups[d]
            groups[d] = more
    assert all(r["component_id"] == min(groups[r["doc_id"]]) for r in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs).count() == len(edge_rows())


@pytest.mark.parametrize("block, short", [(4096, 32), (7, 3)])
def test_all_close_fingerprints_are_linked(spark, block, short):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:6]:
        for _ in range(25):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "f0 long"), 4, block=block, short=short).select("u.f0", F.col("v.f0").alias("g")).collect()
    label = {x: x for x in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in got:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
        label[root(a)] = root(b)
    slow = {x: x for x in signed}

    def sroot(x):
        while slow[x] != x:
            x = slow[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                slow[sroot(a)] = sroot(b)
    assert len({root(x) for x in signed}) == len({sroot(x) for x in signed})
    assert all((root(a) == root(b)) == (sroot(a) == sroot(b)) for a in signed for b in signed[::7])


def test_deduplicated_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    fresh = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(300))
    base = [fresh() for _ in range(30)]
    near = [" ".join("changed" if i == 150 else w for i, w in enumerate(t.split())) for t in base[:10]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + near + base[20:25])], "doc_id long, text string")
    odd = df.select("*", F.lit(1).alias("_row"), F.lit("x").alias("_whole"), F.lit(2.0).alias("f0"), F.lit(3).alias("set_id"))
    again = simhash.deduplicated(odd)
    assert again.columns == odd.columns and again.count() == 30 and again.select("_row", "_whole", "f0", "set_id").distinct().count() == 1
    nameless = spark.createDataFrame([(None, fresh()), (None, fresh()), (None, base[0])], df.schema)
    got = [r["doc_id"] for r in simhash.deduplicated(df.unionAll(nameless)).collect()]
    assert sorted(d for d in got if d is not None) == list(range(30)) and got.count(None) == 2


@pytest.mark.parametrize("block", [1 << 21, 2000])
def test_deduplicated_checks_similarity(spark, block):
    """Pairs of 200 shingles: 178 shared make 0.802, 171 make 0.747."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = []
    for i in range(60):
        for j, shared in ((0, 178), (1000, 171)):
            same = fresh(shared + 4)
            rows += [(2 * i + j, " ".join(same + fresh(200 - shared))), (2 * i + 1 + j, " ".join(same + fresh(200 - shared)))]
    # A group around one text: the copies near it go, those under the limit stay.
    hub = fresh(204)
    rows += [(3000, " ".join(hub))] + [(3001 + i, " ".join(hub[:-20] + fresh(20))) for i in range(40)] + [(3100 + i, " ".join(hub[:-60] + fresh(60))) for i in range(40)]
    rows += [(4000, None), (4001, " "), (4002, rows[0][1].upper()), (4003, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.deduplicated(df, block=block).collect()}
    assert sum(2 * i in got for i in range(60)) == 60 and sum(2 * i + 1 in got for i in range(60)) <= 3
    assert all(i in got for i in range(1000, 1120))
    assert 3000 in got and not got & set(range(3001, 3041)) and got >= set(range(3100, 3140))
    assert got & set(range(4000, 4004)) == {4000}


def test_surrogates(spark):
    rows = [
        (1, "Mail Bob.Lee@Mail8.example.com or bob.lee@mail8.example.com. Call +1 (407) 555-7710, 407-555-7710."),
        (2, "card 4412 4730 1489 4482 and 4412473014894482; ip 10.2.3.4. token = \"a084c530da0e77a3dafc1ad8c55a414de4243423\""),
        (3, "Mr. John Smith met Mrs. Anna Smith; Mr. Smith left. г-жа Анна Петрова"), (4, None), (5, ""), (6, "no data 12 here 3.5 and 1.2.3.4.5"), (6, "no data 12 here 3.5 and 1.2.3.4.5"), (7, "x" * 100_000 + " a@b.co"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_entities int")
    got = {r["doc_id"]: r for r in pii.replaced(df).collect()}
    text = {k: r["text"] for k, r in got.items()}
    assert text[4] is None and text[5] == "" and text[6] == rows[5][1] and got[6]["n_entities_"] == 0 and got[6]["n_entities"] == 5 and pii.replaced(df).count() == len(rows)
    mails = re.findall(r"\S+@\S+\.com", text[1])
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and "bob.lee" not in text[1].lower()
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4})", text[1])[0]
    assert phones[:3] == phones[3:] != ("407", "555", "7710")
    cards = re.findall(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16});", text[2])[0]
    assert cards[0].replace(" ", "") == cards[1] != "4412473014894482"
    assert re.search(r'token = "[0-9a-f]{40}"', text[2]) and "a084c530" not in text[2]
    names = re.findall(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) left\. г-жа ([а-яА-Я]+) ([а-яА-Я]+)", text[3])[0]
    assert names[1] == names[3] == names[4] and names[2].endswith("na") and "Smith" not in text[3]
    assert text[7].startswith("x" * 100_000) and "a@b.co" not in text[7]
    assert pii.replaced(df.limit(0)).count() == 0


def test_surrogates_follow_a_person_through_a_document(spark):
    rows = [
        (1, "Mr. Alex Smith called. Later Dr. Alex Smith wrote; Alex Smith agreed; Smith left. Smithson and Alexa stay."), (2, "Dr. Alex Smith came."),
        (3, "Mrs. Kim Lee met Mr. Kim Roe."), (4, "Alex Smith is not titled here."), (5, "Prof. Kim Lee"), (1, "Mr. Alex Smith called. Later Dr. Alex Smith wrote; Alex Smith agreed; Smith left. Smithson and Alexa stay."),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, k1 int, hits int, row int")
    out = pii.replaced(df)
    assert out.columns == ["doc_id", "text", "k1", "hits", "row", "n_entities"]
    got = {r["doc_id"]: r for r in out.collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) called\. Later Dr\. (\w+) (\w+) wrote; (\w+) (\w+) agreed; (\w+) left\. Smithson and Alexa stay\.", got[1]["text"])
    given, family = m[1], m[2]
    assert m.groups() == (given, family, given, family, given, family, family) and given not in ("Alex", "Smith") and given.endswith("n")
    assert got[2]["text"] == f"Dr. {given} {family} came." and got[4]["text"] == rows[3][1]
    f, l, m_, r = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)\.", got[3]["text"]).groups()
    assert f != m_ and f.endswith("na") and m_.endswith("n") and l != r and got[5]["text"].endswith(l)
    assert (got[1]["k1"], got[1]["hits"], got[1]["row"], got[1]["n_entities"]) == (1, 2, 3, 2)


def test_surrogates_leave_possessives_and_ordinary_words(spark):
    rows = [
        (1, "Mr. Smith left. Mr. Smith's car stayed."), (2, "Mrs. Rose May came in May. May I ask whether a Rose is a Rose?"),
        (3, "Dr. Will Green spoke. Will you join the Green Party?"), (4, "Mr. A.B. and Ms. J. O’Brien’s dog met O’Brien later."), (5, "Dr. Mark Stone said a stone has a mark; then Mark Stone sat, and Stone rose."),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_entities int")
    out = pii.replaced(df)
    assert out.columns == ["doc_id", "text", "n_entities", "n_entities_"] and {r["n_entities"] for r in out.collect()} == {5}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    a, b = re.fullmatch(r"Mr\. (\w+) left\. Mr\. (\w+)'s car stayed\.", got[1]).groups()
    assert a == b != "Smith"
    given, family = re.fullmatch(r"Mrs\. (\w+) (\w+) came in May\. May I ask whether a Rose is a Rose\?", got[2]).groups()
    assert given != "Rose" and family != "May"
    assert re.fullmatch(r"Dr\. (?!Will)\w+ (?!Green)\w+ spoke\. Will you join the Green Party\?", got[3])
    m = re.fullmatch(r"Mr\. (\w+) and Ms\. (\w+) (\w+)’s dog met (\w+) later\.", got[4])
    assert m and m[3] == m[4] and len({m[1], m[2], m[3]}) == 3
    m = re.fullmatch(r"Dr\. (\w+) (\w+) said a stone has a mark; then (\w+) (\w+) sat, and Stone rose\.", got[5])
    assert m and (m[1], m[2]) == (m[3], m[4]) and "Mark" not in m.groups()


def test_names_stay_distinct_over_all_kinds_of_names(spark):
    """A given name's surrogate that is another's family name gets the next attempt."""
    first = spark.createDataFrame([("given:m:latin", "bob"), ("family:n:latin", "lee")], "type string, norm string")
    core = {r["type"]: r["core"] for r in pii.settled(first, "key").collect()}
    again = first.unionAll(spark.createDataFrame([("family:n:latin", core["given:m:latin"].lower())], first.schema))
    cores = [r["core"].lower() for r in pii.settled(again, "key").collect()]
    assert len(set(cores)) == 3 and not set(cores) & {r["norm"] for r in again.collect()}


def test_surrogates_on_all_documents(spark):
    """Entities found as the pattern finds them in Python; each stand-in is a function of its part, and one to one."""
    import regex

    path = "/root/testdata/sf0.001/documents.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("test tables are not here")
    df = spark.read.parquet(path).select("doc_id", "text")
    before = {r["doc_id"]: r["text"] for r in df.collect()}
    pattern, after = regex.compile(pii.PATTERN), {r["doc_id"]: r for r in pii.replaced(df).collect()}
    pairs = set()
    for d, t in before.items():
        hits, out = [m.group(0) for m in pattern.finditer(t or "")], after[d]
        assert out["n_entities"] == len(hits)
        if not hits:
            assert out["text"] == t
            continue
        now = [m.group(0) for m in pattern.finditer(out["text"])]
        assert len(now) == len(hits) and not any(regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(h)}(?![\p{{L}}\p{{N}}])", out["text"]) for h in hits)
        pairs |= {(re.sub(r"[ ().+-]", "", a).lower()[-10:] if "@" not in a else a.lower(), re.sub(r"[ ().+-]", "", b).lower()[-10:] if "@" not in b else b.lower()) for a, b in zip(hits, now) if not regex.match(pii.NAME, a)}
    assert pairs and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def test_surrogates_never_collide(spark):
    """Two-digit parts fill their shape, so attempts must widen it."""
    found = spark.createDataFrame([("card", f"{i:02d}") for i in range(90)], "type string, norm string")
    cores = [r["core"] for r in pii.settled(found, "key").collect()]
    assert len(cores) == len(set(cores)) == 90 and not set(cores) & {f"{i:02d}" for i in range(90)}


def test_audit(spark):
    pages = [(i, f"http://h{i % 7}/{i}", f"<p>{'x' * (i % 50)}</p>") for i in range(700)] + [(5, "http://same/", "twice")] * 3 + [(None, None, None), (None, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.page_audit(df, file_records=64).collect()
    marks = [(p, u, h, hashlib.md5((u or "").encode()).hexdigest()[:2]) for p, u, h in pages]
    want = Counter((p, "missing" if m == "02" else "changed") for p, u, h, m in marks if m == "02" or m in ("00", "01") and (h or m == "00"))
    assert Counter((r["record_id"], r["kind"]) for r in got) == want and want
    a = warc.replica(df.select(F.col("page_id").alias("record_id"), warc.record_text(F.col("url"), F.col("html")).alias("record")), 4)
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0
    assert warc.audit(a.where("not (record_id <=> 9)"), a).select("record_id", "kind").collect() == [(9, "extra")]
    ends = a.groupBy("file").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).collect()
    assert all(r["n"] == r["e"] for r in ends)


def test_first_fit_tree_equals_the_plain_rule():
    rng = random.Random(3)
    for n in (1, 2, 17, 300):
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        free, want = [], []
        for s in sizes:
            k = next((i for i, f in enumerate(free) if f >= s), len(free))
            if k == len(free):
                free.append(100)
            free[k] -= s
            want.append(k)
        assert packing.first_fit(sizes, 100) == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = [(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t, _, _ in edge_rows()]
    rows = packing.pack_documents(docs, path, group_rows=16).collect()
    want = Counter((d, s, min(4096, len(x) - s), zlib.crc32(x[s : s + 4096].tobytes()), len(x)) for d, x in ids for s in range(0, len(x), 4096))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    flat = packing.sequences(docs, path).selectExpr("sum(size(ids))").first()[0]
    assert flat == sum(len(x) for _, x in ids)


def test_shards(spark, docs):
    many = docs.unionByName(spark.range(1000, 5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")), allowMissingColumns=True)
    rows = sharding.sharded(many, part_rows=500, cell_rows=20).collect()
    n = len(edge_rows()) + 4000
    assert len(rows) == n
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in shards.values()]
    assert len(shards) == 40 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    t = (edge_rows()[6][1]).encode()
    assert by_id[6]["size"] == len(t) + 16 and by_id[6]["text_crc32"] == zlib.crc32(t) and by_id[0]["size"] == 16 and by_id[0]["text_crc32"] == 0
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_shards_of_many_partitions_and_cells(spark):
    """A tree of several dealt levels: exact sizes, gapless slots, equal reruns, and a shuffle without trend."""
    ids = spark.range(0, 5000, 1, 7).withColumnRenamed("id", "doc_id")
    runs = [sharding.shuffle_rows(ids, 3, part_rows=20, cell_rows=100).collect() for _ in range(2)]
    first, second = ({r["doc_id"]: (r["shard"], r["slot"]) for r in rows} for rows in runs)
    assert len(runs[0]) == 5000 and first == second and set(first) == set(range(5000))
    slots = defaultdict(dict)
    for i, (shard, slot) in first.items():
        slots[shard][slot] = i
    assert [len(slots[s]) for s in range(3)] == [1667, 1667, 1666] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    for v in slots.values():
        order = np.array([v[k] for k in range(len(v))])
        assert abs(order.mean() - 2499.5) < 4 * 1443 / math.sqrt(len(v))
        assert abs(np.corrcoef(order, np.arange(len(v)))[0, 1]) < 4 / math.sqrt(len(v))


def test_communication_matrix_is_hypergeometric(spark):
    counts = [40, 60, 10, 90]
    caps = [50, 100, 50]
    seen = []
    for seed in range(60):
        m = sharding.communication_matrix(spark.sql(f"SELECT array({', '.join(f'{c}L' for c in counts)}) AS n"), caps, 2, seed)
        rows = np.array([r["sends"] for r in m.orderBy("part").collect()])
        assert (rows.sum(0) == caps).all() and (rows.sum(1) == counts).all() and (rows >= 0).all()
        seen.append(rows[0, 0])
    mean, std = 40 * 50 / 200, math.sqrt(40 * 0.25 * 0.75 * 160 / 199)
    assert abs(np.mean(seen) - mean) < 4 * std / math.sqrt(60) and 0.6 * std < np.std(seen) < 1.5 * std


@pytest.mark.parametrize("name, spaces, end", [("byte_bpe_50k.json", True, 0), ("word_bpe_49k.json", False, 2)])
@pytest.mark.parametrize("most", [5, 1_000_000])
def test_chunk_encoder_equals_the_library(name, spaces, end, most):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary(name)
    bits = ["a", "é", "Ω", "中", "12", " ", "  ", "\n", "\n\n", "\t", ".", ",", "...", "?!", "'", "'s", "don't", "\x01", "\u00a0", "\u0301", "<|endoftext|>", "-", "word", "Word,", "ok."]
    rng = random.Random(7)
    texts = [None, "", "\n", " ", "end\n", "a\n\n\nb c, d.", "zwölf; 3.5, 7!! Ωm. 中文. ok", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    library, ours = Tokenizer.from_file(path), tokens.ChunkEncoder(path, spaces, end, most)
    for x in range(0, len(texts), 700):
        part = texts[x : x + 700]
        ids, lengths = ours.encode(pa.array(part, pa.string()))
        at = np.concatenate(([0], np.cumsum(lengths)))
        for t, a, b in zip(part, at, at[1:]):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids + [end], t


def test_wavelet_file():
    rng = np.random.default_rng(5)
    for n, top in ((0, 10), (1, 1), (1000, 3), (700_000, 50_257)):
        ids = (rng.integers(0, top, n) ** 2 // max(1, top)).astype(np.uint16)
        w = wavelet.WaveletFile(wavelet.build(ids, [1, None], np.array([n, 0])))
        assert (w.decode() == ids).all() and w.documents()[0] == [1, None]
        for i in rng.integers(0, n, 4) if n else []:
            token = int(ids[i])
            where = np.flatnonzero(ids == token)
            assert w.access(int(i)) == token and w.count(token) == len(where) and w.rank(token, int(i)) == (where < i).sum()
            assert w.select(token, len(where) - 1) == where[-1] and w.select(token, 0) == where[0]
        assert w.count(60_000) == 0


def test_wavelet_shards(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    manifest = wavelet.write_shards(docs, path, shard_bytes=100_000)
    assert manifest.agg(F.max("nth")).first()[0] > 0
    rows = wavelet.read_shards(manifest).collect()
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t, _, _ in edge_rows() if d is not None}
    assert len(rows) == len(edge_rows()) and manifest.count() > 1
    assert all(zlib.crc32(ids[r["doc_id"]].tobytes()) == r["ids_crc32"] and r["n_tokens"] == len(ids[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    ordered, at = sorted(rows, key=lambda r: r["start"]), 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert known == sorted(known)
    assert wavelet.read_shards(wavelet.write_shards(docs.limit(0), path)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)) * rng.choice([0.5, 1.0, 3.0], 1500)[:, None]
    x[700:760] = x[40]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    rows += [rows[3], (2000, None, 0), (2020, [], 0), (2040, [0.0] * 16, 0), (2060, [float("nan")] * 16, 0), (2080, [None] * 16, 0), (2100, [1.0, 2.0], 0), (None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.nearest(df, block_rows=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    y = x.astype(np.float32).astype(float)
    hit = 0
    for q, answer in got.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert [a[0] for a in answer] == list(range(1, 21)) and all(math.isclose(s[a[1]], a[2], rel_tol=1e-9, abs_tol=1e-12) for a in answer)
        keys = [(-round(a[2], 9), a[1]) for a in answer]
        assert keys == sorted(keys)
        hit += len(set(best) & {a[1] for a in answer})
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5")).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [i for i in np.lexsort((np.arange(5), -(y[:5] @ y[0]))) if i]
    assert ann.nearest(df.limit(0)).count() == 0


def test_neighbours_at_equal_scores(spark):
    """Many different vectors at one score: the smallest ids win, whatever the blocks."""
    rows = [(i, [1.0, 0.0, float(1 + i * 7 % 300) / 400]) for i in range(1, 300)] + [(1000, [1.0, 0.0, 0.0]), (1020, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, every=1000, block_rows=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {1000: [(i, 1.0) for i in range(1, 21)]}


def test_perturbations_come_in_order_of_cost():
    walls = np.array([0.04, 0.5, 0.09, 0.9, 0.2, 0.6])
    sets = ann.perturbations(walls, 50)
    cost = [sum(walls[i] for i in s) for s in sets]
    assert sets[0] == () and cost == sorted(cost) and len(set(sets)) == len(sets) == 27


def slow_removal(rows, length):
    seen = Counter(t[p : p + length] for t in rows for p in range(len(t) - length + 1))
    out = []
    for t in rows:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        runs = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, most", [(40, 10, 200_000), (40, 10, 3), (40, 10, 20), (25, 20, 200_000)])
def test_repeated_bytes(spark, length, gram, most):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(6)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(30, 60)] if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8))) for _ in range(100)]
    texts += ["a" * 500, None, "", texts[5], "éß" * 90, "xé" + "éß" * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    want = Counter((i, *w) for (i, _), w in zip(rows, slow_removal([(t or "").encode() for _, t in rows], length)))
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, gram=gram, most=most).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_repeated_bytes_on_edge_rows(spark, docs):
    got = suffixes.without_repeats(docs).collect()
    want = Counter((r[0], *w) for r, w in zip(edge_rows(), slow_removal([(t or "").encode() for _, t, _, _ in edge_rows()], 400)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert all(r["text"].encode() == bytes(r["kept"]) and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (7, 8))
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_bytes_of_a_large_group(spark, hot):
    """One passage in most texts, with equal and with different surroundings, and near copies of it."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = say(90)
    near = [passage[:k] + "x" + passage[k + 1 :] for k in range(0, 90, 7)]
    texts = [say(rng.randint(0, 40)) + passage + say(rng.randint(0, 40)) for _ in range(60)] + [rng.choice(["", "abab", say(3)]) + passage[rng.randint(0, 30) :] for _ in range(40)]
    texts += [say(rng.randint(0, 9)) + rng.choice(near) + say(5) for _ in range(60)] + [texts[0]] * 5 + [passage + passage]
    rows = list(enumerate(texts))
    want = Counter((i, *w) for (i, _), w in zip(rows, slow_removal([t.encode() for t in texts], 40)))
    for most in (2, 10, 50):
        got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, hot=hot, gram=10, most=most).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_deep_shallow_sorting():
    rng = random.Random(9)
    stem = bytes(rng.choice(b"ab") for _ in range(500))
    strings = list({stem[: rng.randint(0, 500)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(300)})
    order, lcp = suffixes.deep_shallow(strings, depth=64, char=8)
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings) and lcp[0] == 0
    assert all(n == suffixes.common(a, b) for a, b, n in zip(ranked, ranked[1:], lcp[1:]))


def test_pipeline_on_edge_rows(spark, docs, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of any name go through all stages; so does an empty table."""
    import corpus_pipeline

    vocabulary("word_bpe_49k.json")
    wide = docs.select("*", F.lit(1).alias("_row"), F.lit("x").alias("_quality"), F.lit(2).alias("rows"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (wide, wide.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
            if name != "packing":
                assert now.columns == given.columns, name
            if name in ("quality_rules", "simhash_dedup"):
                assert now.exceptAll(before).count() == 0
            if name == "simhash_dedup":
                assert now.where("text is null").count() <= 1 and now.groupBy("text").count().where("count > 1").count() == 0
    ids = {r[0] for r in edge_rows()}
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r["doc_id"] for r in rows} <= ids and all(0 < r["length"] <= 4096 for r in rows)
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_no_task_compares_a_group_beyond_its_bound(spark, monkeypatch):
    """One document repeats a line of 250 bytes 1,000 times in other surroundings; another shares a passage with it."""
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh") for _ in range(250))
    text = "".join(line + "".join(rng.choice("uvwxyz") for _ in range(rng.randint(20, 60))) for _ in range(1000))
    rows = [(1, text), (2, "start " + text[5_000:6_000] + " end"), (3, "clean " * 100 + str(rng.random()))]
    df, seen, real = spark.createDataFrame(rows, "doc_id long, text string"), [], suffixes.compared

    def watched(contexts, length):
        seen.append(contexts.groupBy("g1", "g2").count().agg(F.max("count")).first()[0] or 0)
        return real(contexts, length)

    monkeypatch.setattr(suffixes, "compared", watched)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffixes.without_repeats(df, most=100).collect()}
    assert max(seen) <= 100 and len(seen) > 1
    assert got[1][1] >= 1000 and got[2][1] >= 1000 and got[2][1] < got[2][0]


def test_audit_reads_the_bytes_of_the_files(spark, tmp_path):
    """Bytes changed on disk after writing, a file cut short and one that is gone are found where they are."""
    from facetry.sources.io import file_system

    rows = [(i, f"record {i} " + "x" * (i % 90)) for i in range(3000)] + [(7, "record 7 again"), (None, "no id")]
    df = spark.createDataFrame(rows, "record_id long, record string")
    folder = f"file://{tmp_path}/second"
    first, index = warc.replica(df, 5), warc.write_archive(df, 5, folder)
    assert warc.audit(first, warc.read_archive(index, folder)).count() == 0
    place, root = file_system(folder)
    for r in index.where("record_id in (100, 2000)").collect():
        with open(warc.file_path(root, r["file"]), "r+b") as f:
            f.seek(r["offset"] + 3)
            f.write(b"#")
    last = index.where("file = 2").orderBy(F.desc("offset")).first()
    with open(warc.file_path(root, 2), "r+b") as f:
        f.truncate(last["offset"] + last["length"] - 1)
    visited = []
    got = {r["record_id"]: r["kind"] for r in warc.audit(first, warc.read_archive(index, folder), visited=visited).collect()}
    assert got == {100: "changed", 2000: "changed", last["record_id"]: "changed"}
    assert visited[0] == 1 and max(visited) <= 3
    __import__("os").remove(warc.file_path(root, 2))
    assert warc.audit(first, warc.read_archive(index, folder)).where("file = 2").count() == index.where("file = 2").count()


def test_packed_archives_hold_the_same_records_in_less_room(spark, tmp_path):
    """Members unpack to the plain file, offsets are those of the plain file, and damage to a member is found."""
    import gzip

    df = spark.createDataFrame([(i, f"record {i % 400} " + "word " * (i % 300)) for i in range(800)] + [(None, "")], "record_id long, record string")
    plain, packed = warc.write_archive(df, 3, f"{tmp_path}/plain"), warc.write_archive(df, 3, f"{tmp_path}/packed", packed=True)
    columns = ["file", "seq", "record_id", "copy", "offset", "length"]
    assert sorted(plain.select(*columns).collect(), key=str) == sorted(packed.select(*columns).collect(), key=str)
    for n in range(3):
        raw, members = (open(warc.file_path(f"{tmp_path}/{kind}", n), "rb").read() for kind in ("plain", "packed"))
        assert gzip.decompress(members) == raw and len(members) < len(raw) / 2
    a = warc.read_archive(plain, f"{tmp_path}/plain")
    assert warc.audit(a, warc.read_archive(packed, f"{tmp_path}/packed", packed=True)).count() == 0
    r = packed.where("record_id = 299").first()
    with open(warc.file_path(f"{tmp_path}/packed", r["file"]), "r+b") as f:
        f.seek(r["at"] + r["stored"] - 6)
        f.write(b"####")
    got = warc.audit(a, warc.read_archive(packed, f"{tmp_path}/packed", packed=True)).collect()
    assert [(x["record_id"], x["kind"], x["record_offset"]) for x in got] == [(299, "changed", r["offset"])]


def test_a_missing_record_moves_no_other_range(spark):
    """Whatever record is lost, one or two nodes of a level differ."""
    df = spark.createDataFrame([(i, f"r{i}") for i in range(4000)], "record_id long, record string")
    a = warc.replica(df, 1).cache()
    for lost in (0, 17, 2222, 3999):
        visited = []
        assert [tuple(r) for r in warc.audit(a, a.where(f"record_id <> {lost}"), visited=visited).select("record_id", "kind").collect()] == [(lost, "missing")]
        assert len(visited) >= 3 and max(visited) <= 2
