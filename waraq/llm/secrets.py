"""Secret scanning with a random forest that removes false positives, on DataFrame functions only.

Candidates are long runs of key characters with a digit. Each is described by its length, its character classes and the
transitions between its characters, the share of it that dictionary words cover, its first characters, the path it stands
in and the words around it. What transitions, first characters, paths and neighbouring words say is learned from one half
of the labelled findings, the forest (Spark's own, on the JVM) from the other half, so that no finding vouches for itself.
The dictionary is the most frequent words of all given texts beside common words of code. Without a table of labelled
findings a made one is used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waraq.runtime import drop_materialized, materialize

CANDIDATE = "[A-Za-z0-9+/_~-]{16,}={0,2}"
#: A cheap test that a text or word holds a candidate: a run of 16 key characters with a digit among them or before them.
HOLDS = "(?=[A-Za-z+/_~-]{0,64}[0-9])[A-Za-z0-9+/_~-]{16}"
#: Characters of a neighbouring word that are looked at.
AROUND = 64
WHITE = "[\\x20\\x09-\\x0D]"

#: Words of code, which identifiers, paths and placeholders hold and real keys do not; the words of the texts come to them.
CODE_WORDS = (
    "access account action address admin answer array article asset author base build button cache change chapter check class client code column comment config content context control convert count create current data date default delete detail device digest display document domain edition element email entry error event example factory field file filter final folder format function general group handler header hidden image index input insert instance item java label language layer layout letter library line link list local login main manager map market message method model module month name network node number object option order page panel param parse part password path pattern picture place player point policy price print process product profile program project property public query random range reader record region release report request resource response result return sample schema screen script search second section select server service session setting shape size source space start state status step store story stream string style summary system table target task template test text theme thread time title token total type update upload user value version video view widget window write your"
).split()
#: Letters of a dictionary word, and how many words of the texts the dictionary takes.
SHORTEST, LONGEST, DICTIONARY_WORDS = 4, 12, 4096
#: Share of all words that a dictionary word has at least.
COMMON = 1e-5
#: Places that neighbouring words, paths and first characters share by their hash, and the share of findings below which one says little.
PLACES, RARE = 4096, 0.005
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_~-="

FEATURES = ["length", "digits", "uppers", "lowers", "signs", "changes", "distinct", "repeats", "hex_only", "digits_only", "uuid_like", "slashes", "assigned", "dictionary", "transitions", "before_high", "before_low", "after", "first", "path_odds"]


@dataclass(frozen=True)
class Learned:
    """The dictionary, the log ratio of every transition between two characters of ALPHABET, and the log odds of every place."""

    words: tuple[str, ...]
    pairs: np.ndarray
    odds: np.ndarray


@dataclass(frozen=True)
class Scanner:
    learned: Learned
    forest: RandomForestClassificationModel


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, word_no, start, slashes, ahead, candidate, w3, w2, w1, x1, for every candidate of every text.

    ahead is the word's part before the candidate, from the candidate before it on; w3 to x1 are the words around, of
    which ``AROUND`` characters on the candidate's side count; slashes are those (and dots) of the word.

    Words are cut at single white-space characters. A word that holds a candidate gets the characters from the last such
    word to it, and a candidate those from the last one of its word; sums of these along the text give exact places (in
    characters from 0), repeats included. All steps look at each word once and carry no list along, so the work grows
    with the text alone. Only candidates are exchanged, never texts.
    """
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), "text").filter(F.col("text").rlike(HOLDS))
    words = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", F.split("text", WHITE, -1).alias("words"))
    near = lambda k: f"'w{k}', coalesce(right(get(words, i - {k}), {AROUND}), '')"
    spots = f"""filter(transform(words, (w, i) -> named_struct('i', i, 'w', w, {near(3)}, {near(2)}, {near(1)},
        'x1', coalesce(left(get(words, i + 1), {AROUND}), ''))), x -> x.w rlike '{HOLDS}')"""
    gaps = "transform(spots, (x, k) -> aggregate(slice(words, coalesce(get(spots, k - 1).i, 0) + 1, x.i - coalesce(get(spots, k - 1).i, 0)), 0L, (n, w) -> n + length(w) + 1))"
    found = words.withColumn("spots", F.expr(spots)).withColumn("gaps", F.expr(gaps))
    found = found.select("row", "doc_id", "path", F.posexplode(F.arrays_zip("spots", "gaps")).alias("k", "z")).select("row", "doc_id", "path", "k", "z.spots.*", "z.gaps")
    along = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("at", F.sum("gaps").over(along))
    # no shorter run of key characters holds a match, so what split leaves are the pieces between the matches
    matches = found.withColumns({"ms": F.expr(f"regexp_extract_all(w, '({CANDIDATE})', 1)"), "pieces": F.expr(f"split(w, '{CANDIDATE}', -1)")})
    matches = matches.withColumn("slashes", (F.length("w") - F.length(F.regexp_replace("w", "[/.]", ""))).cast("double")).drop("w")
    each = "transform(ms, (m, j) -> named_struct('m', m, 'ahead', concat(coalesce(get(ms, j - 1), ''), pieces[j])))"
    kept = ["row", "doc_id", "path", "k", "i", "at", "slashes", "w3", "w2", "w1", "x1"]
    found = matches.select(*kept, F.posexplode(F.expr(each)).alias("j", "z")).select(*kept, "j", "z.m", "z.ahead")
    inside = Window.partitionBy("row", "k").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("p", F.sum(F.length("ahead")).over(inside)).filter("m rlike '[0-9]'")
    return found.select("doc_id", "path", F.col("i").cast("long").alias("word_no"), (F.col("at") + F.col("p")).alias("start"), "slashes", "ahead", F.col("m").alias("candidate"), "w3", "w2", "w1", "x1")


def _share(of: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(of, f"[^{kept}]", "")) / F.greatest(F.length(of), F.lit(1))


def frequent_words(docs: DataFrame, n: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The ``n`` most frequent words (4 to 12 letters of a to z) of all whole texts, of those that are at least COMMON of all
    such words; ties by the word. No more than 1 / COMMON words can be so frequent, so what reaches the driver is bounded.
    Null and empty texts hold none.
    """
    word = f"(?<![\\p{{L}}\\p{{N}}_])([A-Za-z]{{{SHORTEST},{LONGEST}}})(?![\\p{{L}}\\p{{N}}_])"
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(word), F.lit(1))).alias("word"))
    counts = materialize(found.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")), "words")
    least = (counts.agg(F.sum("n")).first()[0] or 0) * COMMON
    common = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(n).collect()
    drop_materialized(counts)
    return tuple(sorted(r["word"] for r in common))


def _hints() -> dict[str, Column]:
    """What stands around a candidate, as lists of hashed places: the words before and after it, its path, its first characters."""
    parts = lambda tag, of: F.transform(F.array_distinct(F.filter(F.split(F.lower(of), "[^\\p{L}]+"), lambda x: x != "")), lambda x: F.pmod(F.xxhash64(F.lit(tag), x), F.lit(PLACES)).cast("int"))
    before = F.concat_ws(" ", "w3", "w2", "w1", F.right("ahead", F.lit(AROUND)))
    first = F.array(F.pmod(F.xxhash64(F.lit("first"), F.left("candidate", F.lit(4))), F.lit(PLACES)).cast("int"))
    return {"before": parts("before", before), "after": parts("after", F.col("x1")), "first": first, "path_odds": parts("path", F.right("path", F.lit(AROUND)))}


def _pairs(c: Column) -> Column:
    """The transitions of a candidate, as places in a table over ALPHABET squared."""
    at = lambda x: F.instr(F.lit(ALPHABET), x) - 1
    pairs = F.regexp_extract_all(F.lower(c), F.lit("(?=(..))"), F.lit(1))
    return F.transform(pairs, lambda x: at(F.left(x, F.lit(1))) * len(ALPHABET) + at(F.right(x, F.lit(1))))


def _covered(c: str, words: tuple[str, ...]) -> Column:
    """Characters of column ``c`` that lie in a dictionary word; from each place the longest word counts. Linear in the length."""
    known = ", ".join(f"'{w}'" for w in words if re.fullmatch(f"[a-z]{{{SHORTEST},{LONGEST}}}", w)) or "''"
    windows = f"regexp_extract_all(concat(lower({c}), '{'=' * (SHORTEST - 1)}'), '(?=(.{{{SHORTEST},{LONGEST}}}))', 1)"
    longest = f"if(w rlike '^[a-z]{{{SHORTEST}}}', coalesce(array_max(filter(sequence({SHORTEST}, length(w)), n -> left(w, n) in ({known}))), 0), 0)"
    spans = f"transform({windows}, (w, i) -> named_struct('a', i, 'b', i + {longest}))"
    grow = "named_struct('end', greatest(s.end, x.b), 'n', s.n + greatest(0, x.b - greatest(s.end, x.a)))"
    return F.expr(f"aggregate({spans}, named_struct('end', 0, 'n', 0), (s, x) -> {grow}, s -> s.n)")


def _table(values: np.ndarray) -> Column:
    """The values as one constant, read from a single string."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def with_features(found: DataFrame, learned: Learned) -> DataFrame:
    """``found``: path, slashes, ahead, candidate, w3, w2, w1, x1, as :func:`candidates` gives them. Adds the columns of FEATURES."""
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1))
    kinds = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    flag = lambda x: x.cast("double")
    looked = lambda table, places: F.transform(places, lambda x: F.get(table, x))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    pair_table, table = _table(learned.pairs), _table(learned.odds)
    odds = {name: looked(table, places) for name, places in _hints().items()}
    return found.withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _share(c, "0-9"),
            "uppers": _share(c, "A-Z"),
            "lowers": _share(c, "a-z"),
            "signs": _share(c, "+/_~=-"),
            "changes": (F.length(F.regexp_replace(kinds, "(.)\\1*", "x")) - 1) / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "repeats": F.length(c) - F.length(F.regexp_replace(c, "(.)\\1+", "$1")).cast("double"),
            "hex_only": flag(c.rlike("^[0-9a-fA-F]+$")),
            "digits_only": flag(c.rlike("^[0-9-]+$")),
            "uuid_like": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
            "assigned": flag(F.col("ahead").rlike("[=:][\"']?$") | F.col("w1").rlike("^(=|:|=>|:=|==)$|[=:]$")),
            "dictionary": _covered("candidate", learned.words) / n,
            "transitions": total(looked(pair_table, _pairs(c))) / n,
            "before_high": F.greatest(F.lit(0.0), F.array_max(odds["before"])),
            "before_low": F.least(F.lit(0.0), F.array_min(odds["before"])),
            "after": total(odds["after"]),
            "first": total(odds["first"]),
            "path_odds": total(odds["path_odds"]),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 8000, first: int = 0) -> DataFrame:
    """A made table of labelled findings: path, w3, w2, w1, word, x1, label, kind. Every value follows from the row's number, from ``first`` on.

    Keys by their publishers' public formats, bare or assigned, against revision and check sums, identifiers, card-like numbers,
    UUIDs, paths, links and placeholders; both with ordinary words around.
    """
    rows = spark.range(first, first + n).select("id")
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    one_of = lambda salt, xs: F.get(F.array(*[F.lit(x) for x in xs]), pick(salt, len(xs)).cast("int"))
    digest = lambda salt: F.sha2(F.concat_ws("-", F.col("id"), F.lit(salt)), 256)
    hexes = lambda salt, k: F.substring(digest(salt), 1, k)
    b64 = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(digest(salt), digest(salt + "x")))), "[\\r\\n=]", ""), 1, k)
    b36 = lambda salt, k: F.substring(F.upper(F.regexp_replace(b64(salt, 86), "[+/]", "")), 1, k)
    alnum = lambda salt, k: F.substring(F.regexp_replace(b64(salt, 86), "[+/]", "7"), 1, k)
    word = ["the", "and", "of", "with", "die", "les", "que", "value", "then", "lines", "for", "before", "nicht", "pour", "desde", "after.", "une,", "sobre"]
    hint = ["password", "passwd", "secret", "token", "api_key", "API_KEY", "access_key", "auth_token", "private", "client_secret"]
    calm = ["commit", "revision", "checksum", "md5", "sha256", "uuid", "etag", "digest", "build", "order", "card", "hash"]
    size = lambda salt, xs: one_of(salt, xs)
    long_hex = F.expr("substring(h, 1, k)")
    base = rows.withColumn("h", F.concat(digest("h"), digest("g"))).withColumn("k", size("k", [18, 20, 24, 32, 40, 48, 64])).withColumn("kind", pick("kind", 20))
    name, calm_word = one_of("hint", hint), one_of("calm", calm)
    digits = F.regexp_replace(F.translate(F.col("h"), "abcdef", ""), "^0+", "4")
    camel = F.concat(one_of("c1", ["get", "make", "load", "parse"]), one_of("c2", ["User", "Order", "Session", "Document"]), one_of("c3", ["Factory", "Handler", "Response", "Template"]), pick("c4", 90).cast("string"))
    snake = F.concat(one_of("s1", ["your", "my", "some", "example"]), F.lit("_"), one_of("s2", ["api_key", "token_value", "secret_here"]), F.lit("_"), pick("s3", 999).cast("string"), F.lit("_goes"))
    route = F.concat(F.lit("/"), one_of("r1", ["usr", "src", "data", "home"]), F.lit("/"), one_of("r2", ["project", "library", "service"]), F.lit("/v"), pick("r3", 9).cast("string"), F.lit("/"), one_of("r4", ["index", "handler", "report"]))
    uuid = F.regexp_replace(hexes("u", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    filler = F.concat(F.repeat(one_of("f1", ["x", "0", "a", "1", "X"]), 16), pick("f2", 10).cast("string"))
    k = F.col("kind")
    cases = [  # (kind, label, word before, the word)
        (0, 1, None, F.concat(F.lit("AKIA"), b36("a", 16))),
        (1, 1, None, F.concat(F.lit("AKIA"), b36("b", 16))),
        (2, 1, name, F.concat(F.lit("ghp_"), alnum("c", 36))),
        (3, 1, None, F.concat(F.lit("sk_live_"), alnum("d", 24))),
        (4, 1, name, F.concat(F.lit("\""), long_hex, F.lit("\""))),
        (5, 1, None, F.concat(name, F.lit("="), long_hex)),
        (6, 1, None, F.concat(name, F.lit("=\""), b64("e", 40), F.lit("\""))),
        (7, 1, name, b64("f", 40)),
        (8, 1, name, alnum("g", 32)),
        (9, 1, None, F.concat(F.lit("AIza"), alnum("i", 35))),
        (10, 0, calm_word, long_hex),
        (11, 0, calm_word, F.concat(F.lit("\""), long_hex, F.lit("\""))),
        (12, 0, None, F.substring(digits, 1, 16)),
        (13, 0, None, F.substring(digits, 1, 16)),
        (14, 0, None, uuid),
        (15, 0, None, camel),
        (16, 0, name, snake),
        (17, 0, None, F.concat(F.lit("https://host.example"), route)),
        (18, 0, name, filler),
        (19, 0, None, long_hex),
    ]
    case = lambda i: F.coalesce(*[F.when(k == c[0], c[i] if isinstance(c[i], Column) else F.lit(c[i])) for c in cases])
    ahead = case(2)
    equals = ahead.isNotNull() & (pick("eq", 3) > 0)
    return base.select(
        one_of("path", ["src/app.py", "config/prod.env", "src1", "notes.txt", "tests/data.json", "docs/example.md"]).alias("path"),
        F.when(equals, one_of("w3", word)).otherwise(one_of("w3b", word)).alias("w3"),
        F.when(equals, ahead).otherwise(one_of("w2", word)).alias("w2"),
        F.when(equals, F.lit("=")).when(ahead.isNotNull(), F.concat(ahead, F.lit(":"))).otherwise(one_of("w1", word)).alias("w1"),
        case(3).alias("word"),
        one_of("x1", word).alias("x1"),
        case(1).cast("double").alias("label"),
        "kind",
    )


def _by_label(rows: DataFrame, places: Column, size: int) -> np.ndarray:
    """(2, size): how many rows of either label hold each place. At most ``size`` counts of either reach the driver."""
    out = np.zeros((2, size))
    for r in rows.select("label", F.explode(places).alias("place")).groupBy("label", "place").count().collect():
        out[int(r["label"]), r["place"]] = r["count"]
    return out


def learn(findings: DataFrame, words: tuple[str, ...]) -> Learned:
    """What transitions and surroundings say, from findings with their candidates and labels."""
    k = len(ALPHABET)
    pairs = _by_label(findings, _pairs(F.col("candidate")), k * k).reshape(2, k, k) + 1
    pairs = np.log(pairs / pairs.sum(axis=2, keepdims=True))
    held = _by_label(findings, F.concat(*_hints().values()), PLACES)
    sizes = {int(r["label"]): r["count"] for r in findings.groupBy("label").count().collect()}
    share = held / np.array([[max(1, sizes.get(y, 0))] for y in (0, 1)]) + RARE
    return Learned(words, (pairs[1] - pairs[0]).ravel(), np.log(share[1] / share[0]))


def train(labelled: DataFrame, words: tuple[str, ...] = (), trees: int = 24, depth: int = 8, seed: int = 17) -> Scanner:
    """A scanner from labelled findings: path, w3, w2, w1, word, x1, label (1.0 a secret, 0.0 not); ``words`` join CODE_WORDS.

    Findings without a candidate or a label are left out. The half of the findings is told by a hash of their candidates,
    so findings of one candidate stay together.
    """
    kept = materialize(labelled.select("path", "w3", "w2", "w1", "word", "x1", "label"), "findings")
    found = kept.withColumn("candidate", F.regexp_extract("word", f"({CANDIDATE})", 1)).filter("candidate <> '' and label in (0, 1)")
    found = found.withColumn("ahead", F.expr("substring(word, 1, locate(candidate, word) - 1)"))  # of a finding's word the first candidate is labelled
    found = found.withColumn("slashes", (F.length("word") - F.length(F.regexp_replace("word", "[/.]", ""))).cast("double"))
    half = F.pmod(F.xxhash64(F.lit("half"), "candidate"), F.lit(2))
    learned = learn(found.filter(half == 0), tuple(sorted({*words, *(w for w in CODE_WORDS if SHORTEST <= len(w) <= LONGEST)})))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found.filter(half == 1), learned)).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt").fit(rows)
    drop_materialized(kept)
    return Scanner(learned, forest)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate of every whole text: doc_id, word_no, start, candidate, score, is_secret.

    word_no counts white-space-separated words from 0 (empty ones too), start characters from 0. Every place of
    a candidate is a row of its own. Null and empty texts: no rows. Null ids and paths: scanned like any other.
    Repeated rows: repeated findings. Very long texts: scanned whole. Empty table: no rows.
    """
    scanner = train(labelled_findings(docs.sparkSession) if labelled is None else labelled, frequent_words(docs))
    return judge(candidates(docs), scanner, threshold)


def judge(found: DataFrame, scanner: Scanner, threshold: float = 0.5) -> DataFrame:
    """The candidates that :func:`candidates` gives, each with the forest's score."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, scanner.learned))
    score = vector_to_array("probability")[1]
    return scanner.forest.transform(rows).select("doc_id", "word_no", "start", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))
