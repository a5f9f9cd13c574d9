"""Personal data replaced by keyed, type-consistent surrogates [native].

One pattern finds e-mail and IPv4 addresses, phone, card, account and social security numbers,
secrets and titled names. A surface is reduced to its parts: a phone number to its last ten digits,
an e-mail to lower case, a titled name to given and family name with gender and script. Each distinct
(type, part) gets a surrogate of the same shape from SHA-512 of key, type, part and attempt: digits for
digits, letters for letters, names of the same gender and script. Parts whose surrogate another part
has, or that is itself a part of the corpus, try again with the next attempt (from the fourth on with a
longer surrogate, so rounds end). So distinct parts stay distinct, and the same part gets the same
surrogate in every spelling and document. Names are kept distinct over given and family names of all
genders together. A possessive 's stays as it is; initials get whole names, as there are too few letters.

A given name's gender is that of its title; where the title shows none, it is the one gender that the
same document's titles show for the name, else the one that most titles of the corpus do. Names found
by a title are also replaced where the same document repeats them without a title: the parts side by
side anywhere; a single part only where it is no ordinary word, that is if the document has it neither
in lower case nor, untitled, at the start of a sentence, and not after an article or before another
capital. So a lone family name that begins a sentence stays as it is.

Texts are scanned for entities once and known by two 64-bit hashes; only those with entities are joined
with their surrogates. Edge cases: null stays null, empty stays empty, texts of any length are scanned
whole, repeated rows are replaced alike, other columns are kept as they are (working columns are named
apart from them); an entity without a surrogate is masked, never passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import cut, spread_join, written

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"], "n": ["Dr", "Prof", "Mx"]}
TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + ")"
# A word of a name, ending before a possessive 's; or initials.
WORD = r"(?:\p{Lu}(?:\p{L}|['’](?![sS](?![\p{L}\p{N}]))(?=\p{L}))+|(?:\p{Lu}\.)+)"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}\.? {WORD}(?:[ -]{WORD}){{0,2}}"
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,})(?![\p{L}\p{N}])",
    r"(?<=(?i:token|secret|password|passwd|api[_-]?key)[\"']{0,1}[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[A-Za-z0-9_+/.-]{8,}",
    NAME,
])
#: What any match contains: cheap to look for.
HINT = rf"[0-9@]|(?i:token|secret|passw|api[_-]?key)|{TITLE}\.? \p{{Lu}}"
SYLLABLES = {
    "latin": "ba ce di fo lu ma ne pi ro su ta ve wi zo ka le".split(),
    "cyrillic": "ба ве ди фо лу ма не пи ро су та зе ви жо ка ле".split(),
    "greek": "βα γε δι φο λου μα νε πι ρο σου τα ζε βι θο κα λε".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "r"}, "cyrillic": {"m": "н", "f": "на", "n": "р"}, "greek": {"m": "ς", "f": "να", "n": "ρ"}}


def kind(s: Column) -> Column:
    return (
        F.when(s.rlike(rf"^{NAME}$"), "name").when(s.contains("@"), "email").when(s.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(s.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(s.rlike(r"^\+?[0-9(][0-9() .-]*$") & (s.rlike(r"[+(]") | (F.length(F.regexp_replace(s, "[^0-9]", "")) < 13)), "phone")
        .when(s.rlike(r"^[0-9 -]+$"), "card").otherwise("secret")
    )


def parts(s: Column) -> Column:
    """Array of (lead: text kept as it is, type, surface, norm) of a surface."""
    title = F.regexp_extract(s, rf"^{TITLE}", 0)
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    script = F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    lead = F.regexp_extract(s, rf"^{TITLE}\.? ", 0)
    names = F.regexp_extract_all(F.substr(s, F.length(lead) + 1), F.lit(r"[ -]?[^ -]+"), 0)
    named = F.transform(names, lambda n, i: F.struct(
        F.concat(F.when(i == 0, lead).otherwise(F.lit("")), F.regexp_extract(n, r"^[ -]?", 0)).alias("lead"),
        F.when(i == F.size(names) - 1, F.concat_ws(":", F.lit("family"), F.lit("n"), script)).otherwise(F.concat_ws(":", F.lit("given"), gender, script)).alias("type"),
        F.regexp_replace(n, "^[ -]", "").alias("surface"), F.lower(F.regexp_replace(n, "^[ -]", "")).alias("norm")))
    digits = F.regexp_replace(s, "[^0-9]", "")
    k = kind(s)
    norm = F.when(k == "phone", F.right(digits, F.lit(10))).when(k.isin("card", "ssn"), digits).when(k == "iban", F.replace(s, F.lit(" "))).when(k == "secret", s).otherwise(F.lower(s))
    return F.when(k == "name", named).otherwise(F.array(F.struct(F.lit("").alias("lead"), k.alias("type"), s.alias("surface"), norm.alias("norm"))))


def surrogate(kind_: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The keyed stand-in of a normalised part, of the same shape."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind_, norm, attempt.cast("string")), 512)
    more = F.when(attempt < 4, F.lit(0)).otherwise(attempt - 3)
    byte = lambda i: F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def spelled(script: str) -> Column:
        ends = ENDINGS[script]
        gender = F.split_part(kind_, F.lit(":"), F.lit(2))
        end = F.when(kind_.startswith("family"), "").when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends["n"])
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        return F.concat(F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), 3 + more), lambda i: F.get(syllables, byte(i) % 16)), "")), end)

    tld = F.when(kind_ == "email", F.length(F.regexp_extract(norm, r"\.[^.]*$", 0))).otherwise(0)
    letters = lambda c, i: (
        F.when(i >= F.length(norm) - tld, c).when(c.rlike("[0-9]"), (byte(i) % 10).cast("string"))
        .when(c.rlike(r"\p{Lu}"), F.chr(F.lit(65) + byte(i) % 26)).when(c.rlike(r"\p{L}"), F.chr(F.lit(97) + byte(i) % 26)).otherwise(c)
    )
    hexed = lambda c, i: F.when(c.rlike("[A-F]"), F.upper(F.substr(digest, (i % 128) + 1, F.lit(1)))).when(c.rlike("[0-9a-f]"), F.substr(digest, (i % 128) + 1, F.lit(1))).otherwise(c)
    chars = F.split(norm, "")
    octets = F.concat_ws(".", *[(byte(F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    shape = F.array_join(F.transform(chars, letters), "")
    shape = F.when(more > 0, F.concat(F.when(kind_.isin("phone", "card", "ssn"), F.substr(F.regexp_replace(digest, "[^0-9]", "7"), F.lit(1), more + 1)).otherwise(F.substr(digest, F.lit(1), more + 1)), shape)).otherwise(shape)
    script = F.split_part(kind_, F.lit(":"), F.lit(3))
    return (
        F.when(kind_.contains(":"), F.when(script == "cyrillic", spelled("cyrillic")).when(script == "greek", spelled("greek")).otherwise(spelled("latin")))
        .when(kind_ == "ip", octets).when((kind_ == "secret") & norm.rlike("^[0-9a-fA-F]+$"), F.array_join(F.transform(chars, hexed), "")).otherwise(shape)
    )


def rendered(kind_: Column, surface: Column, core: Column) -> Column:
    """The surrogate in the surface's layout: separators, leading country code and case stay."""
    digits = F.length(F.regexp_replace(surface, "[^0-9]", ""))
    chars, n = F.split(surface, ""), F.length(core)
    laid = F.aggregate(
        F.reverse(chars), F.struct(F.lit("").alias("o"), F.lit(0).alias("p")),
        lambda s, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(F.when(s["p"] < n, F.substr(core, n - s["p"], F.lit(1))).otherwise(c), s["o"]).alias("o"), (s["p"] + 1).alias("p"))).otherwise(F.struct(F.concat(c, s["o"]).alias("o"), s["p"].alias("p"))),
        lambda s: s["o"],
    )
    extra = F.when(n > digits, F.left(core, n - digits)).otherwise("")
    upper = (F.length(surface) > 1) & (F.upper(surface) == surface) & surface.rlike(r"\p{L}")
    return F.when(kind_.isin("phone", "card", "ssn"), F.concat(extra, laid)).when(kind_ == "iban", laid).when(upper & (kind_ != "secret"), F.upper(core)).otherwise(core)


def settled(found: DataFrame, key: str) -> DataFrame:
    """type, norm -> core, with every collision resolved; the loop's driver side sees one count a round."""
    family = lambda t: F.when(F.col(t).contains(":"), "name").otherwise(F.col(t))
    cores = found.select("type", "norm").distinct().withColumn("attempt", F.lit(0))
    while True:
        now = cut(cores.withColumn("core", surrogate(F.col("type"), F.col("norm"), F.col("attempt"), key)))
        real = now.select(family("type").alias("_t"), F.lower("norm").alias("_n")).distinct().withColumn("_real", F.lit(True))
        rank = F.row_number().over(W.partitionBy("_kind", F.lower("core")).orderBy("norm", "type"))
        judged = cut(now.withColumn("_kind", family("type")).withColumn("_rank", rank).join(real, (F.col("_kind") == F.col("_t")) & (F.lower("core") == F.col("_n")), "left").withColumn("_again", (F.col("_rank") > 1) | F.col("_real").isNotNull()))
        if not judged.where("_again").limit(1).count():
            return judged.select("type", "norm", "core")
        cores = judged.select("type", "norm", (F.col("attempt") + F.col("_again").cast("int")).alias("attempt"))


def gendered(names: DataFrame) -> DataFrame:
    """``names`` (k1, k2, type, norm, ...) with the gender of given names settled, as the module says."""
    part = lambda i: F.split_part("type", F.lit(":"), F.lit(i))
    named = names.select("*", part(1).alias("_role"), part(2).alias("_own"), part(3).alias("_script"))
    votes = named.where("_role = 'given'").groupBy("norm", "_script").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum((F.col("_own") == "m").cast("int")).alias("_m"), F.sum((F.col("_own") == "f").cast("int")).alias("_f"))
    votes = votes.select("norm", "_script", "_rows", F.when(F.col("_m") > F.col("_f"), "m").when(F.col("_m") < F.col("_f"), "f").otherwise("n").alias("_most"))
    here = W.partitionBy("k1", "k2", "norm", "_script")
    has = lambda g: F.max((F.col("_own") == g).cast("int")).over(here) == 1
    given = spread_join(named.where("_role = 'given'").withColumn("_hm", has("m")).withColumn("_hf", has("f")), votes, ["norm", "_script"], "_rows")
    gender = F.when(F.col("_own") != "n", F.col("_own")).when(F.col("_hm") & ~F.col("_hf"), "m").when(F.col("_hf") & ~F.col("_hm"), "f").otherwise(F.col("_most"))
    given = given.withColumn("type", F.concat_ws(":", F.lit("given"), gender, "_script"))
    return given.select(*names.columns).unionAll(named.where("_role = 'family'").select(*names.columns))


def replaced(docs: DataFrame, key: str = "set-a-secret-key", text: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text`` and a column ``count`` (long): the entities found by the pattern."""
    while count in docs.columns:
        count += "_"
    others = [c for c in docs.columns if c != text]
    row = F.struct(*others) if others else F.lit(None).cast("int")
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0))
    marked = written(docs.select(row.alias("row"), F.col(text).alias("text"), F.when(F.size(found) > 0, found).alias("hits")), "entities")
    held = marked.where("hits is not null").select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(key), "text").alias("k2"))
    texts = held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.first("hits").alias("hits"))
    spots = written(texts.select("k1", "k2", F.explode(F.array_distinct("hits")).alias("whole")).withColumn("kind", kind(F.col("whole"))), "spots")

    names = spots.where("kind = 'name'").select("k1", "k2", "whole", F.posexplode(parts(F.col("whole"))).alias("j", "p")).select("k1", "k2", "whole", "j", "p.*")
    names = written(gendered(names), "names")
    plain = spots.where("kind <> 'name'").groupBy("whole").agg(F.count(F.lit(1)).alias("spots"))
    plain = plain.select("whole", "spots", F.explode(parts(F.col("whole"))).alias("p")).select("whole", "spots", "p.*")
    known = names.groupBy("type", "norm").agg(F.count(F.lit(1)).alias("uses"))
    cores = settled(known.select("type", "norm").unionAll(plain.select("type", "norm")), key)

    shown = rendered(F.col("type"), F.col("surface"), F.col("core")).alias("stand_in")
    plain = plain.join(cores, ["type", "norm"]).select("whole", "spots", shown)
    plain = spread_join(spots.where("kind <> 'name'").select("k1", "k2", "whole"), plain, ["whole"], "spots").select("k1", "k2", "whole", "stand_in")
    named = written(spread_join(names, known.join(cores, ["type", "norm"]), ["type", "norm"], "uses").select("k1", "k2", "whole", "j", "type", "lead", "surface", shown), "named")
    whole = named.groupBy("k1", "k2", "whole").agg(F.array_sort(F.collect_list(F.struct("j", F.concat("lead", "stand_in").alias("s")))).alias("a"))
    whole = whole.select("k1", "k2", "whole", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("stand_in"))
    apart = lambda word: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), word, F.lit(r"(?![\p{L}\p{N}])"))
    spaced = lambda x, c: F.concat(F.regexp_extract(x["lead"], "[ -]$", 0), x[c])
    rows = named.groupBy("k1", "k2", "whole").agg(F.array_sort(F.collect_list(F.struct("j", "lead", "surface", "stand_in"))).alias("a")).where("size(a) > 1")
    side = lambda c: F.array_join(F.transform("a", lambda x, i: F.when(i == 0, x[c]).otherwise(spaced(x, c))), "")
    rows = rows.select("k1", "k2", side("surface").alias("surface"), side("stand_in").alias("put")).withColumn("single", F.lit(False)).withColumn("find", apart(F.replace("surface", F.lit("."), F.lit(r"\."))))
    lone = named.where(~F.col("surface").contains(".")).groupBy("k1", "k2", "surface").agg(F.min(F.struct("type", "stand_in")).alias("s"))
    lone = lone.select("k1", "k2", "surface", F.col("s.stand_in").alias("put"), F.lit(True).alias("single"), F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<!(?<![\p{L}])(?:[Aa]|[Aa]n|[Tt]he) )"), "surface", F.lit(r"(?![\p{L}\p{N}]|[ -]\p{Lu}\p{L})")).alias("find"))
    every = rows.groupBy("k1", "k2", "surface", "single", "find").agg(F.min("put").alias("put")).unionByName(lone)
    again = every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("single", (-F.length("surface")).alias("n"), "surface", "find", "put"))).alias("again"))
    maps = plain.unionAll(whole).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("whole", "stand_in"))).alias("map"))
    maps = maps.join(again, ["k1", "k2"], "left").join(texts.select("k1", "k2", "rows"), ["k1", "k2"])

    stand_in = lambda h: F.coalesce(F.try_element_at("map", h), F.repeat(F.lit("*"), F.length(h)))
    # What stands between the entities; \x00 marks their places.
    untitled = F.array_join("_between", "\x00")
    starts = lambda word: F.concat(F.lit(r"(?:^|[.!?…][\"'”’)]{0,3}\s|\n)\s{0,9}"), word, F.lit(r"(?![\p{L}\p{N}]|[ -]\p{Lu}\p{L})"))
    ordinary = lambda a: F.contains(F.col("_gaps"), F.lower(a["surface"])) & F.regexp_like(F.col("_gaps"), apart(F.lower(a["surface"]))) | F.regexp_like(F.col("_gaps"), starts(a["surface"]))
    usable = F.filter("again", lambda a: F.contains(F.col("_gaps"), a["surface"]) & (~a["single"] | ~ordinary(a)))
    repeats = lambda s: F.when(F.col("_again").isNull(), s).otherwise(F.aggregate("_again", s, lambda t, a: F.when(F.contains(t, a["surface"]), F.regexp_replace(t, a["find"], a["put"])).otherwise(t)))
    met = spread_join(held, maps, ["k1", "k2"], "rows").withColumn("_between", F.split("text", PATTERN, -1)).withColumn("_gaps", untitled).withColumn("_again", usable)
    done = met.select(
        "row", F.array_join(F.zip_with("_between", "hits", lambda p, h: F.concat(repeats(p), F.when(h.isNull(), "").otherwise(stand_in(h)))), "").alias("text"), F.size("hits").cast("long").alias("n"))
    rest = marked.where("hits is null").select("row", "text", F.lit(0).cast("long").alias("n"))
    columns = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return done.unionAll(rest).select(*columns, F.col("n").alias(count))
