"""Secret scan: fixed patterns, and a battery of randomness tests for everything else.

Built-in expressions only. Patterns give spans of three kinds (assign, access, hex).
Long runs of encoding characters are candidates for a fourth kind, random: from its
characters an encoding is inferred (hex, base32, base64), and three tests ask whether
the symbols look drawn at random from that alphabet: Pearson's chi-squared for uniformity
(moments exact for short strings), the number of runs across the alphabet's halves,
and lag-one serial correlation. Their p-values are combined by Cauchy's rule.

Random strings have uniform p-values; ordinary ones pile up near zero. How many ordinary ones still pass a
threshold is measured on a null: words drawn, capitalised, numbered and joined at random, of the same encoding
and length class. A class is a mixture of the two; its random strings are those over a half beyond what the null explains. The null's share of
the rest, held against all that pass a threshold, estimates the false discoveries, and the smallest threshold is taken that keeps
them under ``fdr``. Short strings, where the tests have less power, get a stricter one, and a class in which no threshold will do,
as it has ordinary strings only or too short ones, flags nothing. Strings under 20 characters are not tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

KINDS = ("assign", "access", "hex", "random")

# Fixed values of the contract.
ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = {"hex": 16, "base32": 32, "base64": 64}
FDR = 0.05
LEVEL = 0.01
HIGHEST = 0.9
BINS = 100
NULL = 5000  # strings of the null per class
NULL_LENGTH = 1024  # their greatest length; longer strings fail the tests the more clearly
# Fixed words of the null.
WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there "
    "would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these "
    "two may then do first any my now such like our over man me even most made after also did many before must through back years where much your "
    "way well down should because each just those people how too little state good very make world still own see men work long get here between "
    "both life being under never day same another know while last might us great old year off come since against go came right used take three"
).split()

SPAN = "struct<kind:int,start:int,stop:int>"
CANDIDATES = "array<struct<start:int,stop:int,enc:string,n:int,p:double>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches, in code points.

    Java's split keeps every piece between matches, so lengths add up to positions. Texts without
    a match, nearly all, are scanned once only.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), whole.alias("whole"), value.alias("value")
    ).cast("array<struct<piece:string,whole:string,value:string>>")
    kind = "array<struct<start:int,stop:int,value:string>>"

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["piece"])
        stop = start + F.coalesce(F.length(part["whole"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), stop.alias("stop"), part["value"].alias("value")))
        spans = F.when(part["whole"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], found.cast(kind)))
        return F.struct(stop.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), _none(kind).alias("spans"))
    walked = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(_none(kind))


def _spans(located: Column, kind: int) -> Column:
    return F.transform(
        located, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))
    ).cast(f"array<{SPAN}>")


# --- the battery ---------------------------------------------------------------------------


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )


def _symbol(char: Column, encoding: Column) -> Column:
    """Place of a character in the alphabet of its encoding."""
    code = F.ascii(char)
    return (
        F.when(encoding == "hex", F.when(code < 58, code - 48).when(code < 71, code - 55).otherwise(code - 87))
        .when(encoding == "base32", F.when(code < 58, code - 24).otherwise(code - 65))
        .when(char.isin("+", "-"), 62)
        .when(char.isin("/", "_"), 63)
        .when(code < 58, code + 4)
        .when(code < 91, code - 65)
        .otherwise(code - 71)
    ).cast("double")


def _upper_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (polynomial approximation, error under 2e-7)."""
    x = F.abs(z) / 2.0**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + c
    half = 0.5 * poly * t * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def _p_value(symbols: Column, n: Column, size: Column) -> Column:
    """Combined p-value of the battery for one string of ``n`` symbols out of ``size``."""
    mean, variance = (size - 1) / 2, (size * size - 1) / 12

    def count(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1.0)
        return F.struct(x.alias("last"), run.alias("run"), (acc["squares"] + 2 * run - 1).alias("squares"))

    squares = F.aggregate(
        F.sort_array(symbols),
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares")),
        count,
        lambda acc: acc["squares"],
    )

    def follow(acc: Column, x: Column) -> Column:
        first = acc["last"] < 0
        turned = ((x >= size / 2) != (acc["last"] >= size / 2)).cast("double")
        return F.struct(
            x.alias("last"),
            (acc["turns"] + F.when(first, 0.0).otherwise(turned)).alias("turns"),
            (acc["lagged"] + F.when(first, 0.0).otherwise((x - mean) * (acc["last"] - mean))).alias("lagged"),
        )

    walk = F.aggregate(
        symbols, F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("lagged")), follow
    )

    def combine(s: Column, w: Column) -> Column:
        chi = size * s / n - n
        shape = (size - 1) * n / (2 * (n - 1))  # of the gamma with the statistic's own mean and variance
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (size - 1), F.lit(1 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)
        z_runs = (2 * w["turns"] - (n - 1)) / F.sqrt(n - 1)
        z_serial = w["lagged"] / (variance * F.sqrt(n - 1))
        tests = (_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial)))
        pi = 3.141592653589793
        each = [F.tan(pi * (0.5 - F.greatest(F.lit(1e-12), F.least(F.lit(0.99), p)))) for p in tests]
        return 0.5 - F.atan((each[0] + each[1] + each[2]) / 3) / pi

    pair = F.array(F.struct(squares.alias("s"), walk.alias("w")))
    return F.transform(pair, lambda x: combine(x["s"], x["w"]))[0]


def _candidates(text: Column) -> Column:
    def bare(m: Column) -> Column:
        token = F.rtrim(m["value"], F.lit("="))
        return F.struct(
            m["start"].alias("start"), m["stop"].alias("stop"), _encoding(token).alias("enc"), token.alias("token")
        )

    def spelt(c: Column) -> Column:
        symbols = F.transform(F.split(c["token"], ""), lambda ch: _symbol(ch, c["enc"]))
        return F.struct(
            c["start"].alias("start"),
            c["stop"].alias("stop"),
            c["enc"].alias("enc"),
            F.length(c["token"]).alias("n"),
            symbols.alias("symbols"),
        )

    def tested(c: Column) -> Column:
        size = F.when(c["enc"] == "hex", 16.0).when(c["enc"] == "base32", 32.0).otherwise(64.0)
        p = _p_value(c["symbols"], c["n"].cast("double"), size)
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["enc"].alias("enc"), c["n"].alias("n"), p.alias("p"))

    found = _located(text, CANDIDATE)
    return F.transform(F.transform(F.transform(found, bare), spelt), tested).cast(CANDIDATES)


# --- scan ----------------------------------------------------------------------------------


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (spans of the fixed patterns) and ``_candidates`` (tested strings).

    A null text counts as empty; both arrays are then empty. No shuffle: each row is scanned where it is.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(_located(t, ASSIGN, 1), lambda m: F.length(m["value"]) >= MIN_ASSIGNED)
    base = F.concat(_spans(assigned, 0), _spans(_located(t, ACCESS), 1), _spans(_located(t, HEX), 2))
    return docs.withColumns({"_base": base, "_candidates": _candidates(t)})


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _binned(enc: Column, length: Column, p: Column) -> list[Column]:
    return [
        enc.alias("enc"), length.alias("class"),
        F.greatest(F.lit(0), F.least(F.floor(p * BINS), F.lit(BINS - 1))).cast("int").alias("bin"),
    ]


def _ordinary(enc: Column, n: Column, seed: Column) -> Column:
    """A string of words of about n characters, such as names in code and identifiers are, in the alphabet of an encoding."""
    words = F.array(*[F.lit(w) for w in WORDS])

    def word(i: Column) -> Column:
        w, style = F.get(words, F.pmod(F.xxhash64(seed, i), F.lit(len(WORDS))).cast("int")), F.pmod(F.xxhash64(i, seed), F.lit(5))
        return (
            F.when(style == 0, F.initcap(w)).when(style == 1, F.concat(w, F.lit("_"))).when(style == 2, F.concat(w, F.lit("-")))
            .when(style == 3, F.concat(w, F.pmod(F.xxhash64(i, seed, i), F.lit(100)).cast("string"))).otherwise(w)
        )

    joined = F.array_join(F.transform(F.sequence(F.lit(1), n), word), "")
    own = (
        F.when(enc == "hex", F.regexp_replace(F.lower(joined), "[^0-9a-f]", ""))
        .when(enc == "base32", F.regexp_replace(F.upper(joined), "[^A-Z2-7]", ""))
        .otherwise(joined)
    )
    return F.substring(own, F.lit(1), n)


def null_counts(classes: DataFrame) -> DataFrame:
    """(enc, class, bin, null): the p-values of NULL ordinary strings for each class, of the class's least length."""
    n = F.greatest(F.lit(20), F.least(F.lit(NULL_LENGTH), F.pow(F.lit(2.0), F.col("class")))).cast("int")
    seeds = F.explode(F.sequence(F.lit(1), F.lit(NULL))).alias("seed")
    drawn = classes.select("enc", "class", n.alias("n"), seeds).repartition("enc", "class", "seed")
    token = _ordinary(F.col("enc"), F.col("n"), F.col("seed"))
    spelt = drawn.select("enc", "class", token.alias("token"))
    spelt = spelt.select("enc", "class", F.length("token").alias("n"), F.transform(F.split("token", ""), lambda ch: _symbol(ch, F.col("enc"))).alias("symbols"))
    size = F.when(F.col("enc") == "hex", 16.0).when(F.col("enc") == "base32", 32.0).otherwise(64.0)
    p = _p_value(F.col("symbols"), F.col("n").cast("double"), size)
    return spelt.select(*_binned(F.col("enc"), F.col("class"), p)).groupBy("enc", "class", "bin").agg(F.count("*").alias("null"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per encoding and length class in which a threshold will do: the p-value that a random string must exceed.

    At most three encodings times 31 classes. Of m strings, with T over a half and the null's share q there, about (T - m q) / (1/2 - q)
    are random. The others, times the null's share over t, are false discoveries at t; the smallest t on a grid of hundredths is taken (at
    least ``LEVEL``, at most ``HIGHEST``) at which they are at most ``fdr`` of the strings over t. A null's share is never
    taken for less than 1 / (NULL + 1), so where fewer than about one string in 250 is random, none is flagged.
    """
    tested = scanned.select(F.explode("_candidates").alias("c"))
    counts = tested.select(*_binned(F.col("c.enc"), _length_class(F.col("c.n")), F.col("c.p"))).groupBy("enc", "class", "bin").count()
    counts = stored(counts, "p-values")
    classes = counts.groupBy("enc", "class").agg(F.sum("count").alias("m"))
    both = counts.withColumn("null", F.lit(0)).unionByName(null_counts(classes.select("enc", "class")).withColumn("count", F.lit(0)))
    grid = F.explode(F.sequence(F.lit(max(1, int(LEVEL * BINS))), F.lit(int(HIGHEST * BINS)))).alias("t")
    half = F.col("bin") >= BINS // 2
    over = (
        classes.select("*", grid)
        .join(both, ["enc", "class"])
        .groupBy("enc", "class", "m", "t")
        .agg(
            *(F.sum(F.when(F.col("bin") >= F.col("t"), F.col(c)).otherwise(0)).alias(f"{c}_over") for c in ("count", "null")),
            *(F.sum(F.when(half, F.col(c)).otherwise(0)).alias(f"{c}_half") for c in ("count", "null")),
        )
    )
    q_half, q = ((1 + F.col(c)) / (NULL + 1) for c in ("null_half", "null_over"))
    random = F.greatest(F.lit(0.0), (F.col("count_half") - F.col("m") * q_half) / F.greatest(F.lit(0.05), 0.5 - q_half))
    ordinary = F.greatest(F.lit(1.0), F.col("m") - random)
    wrong = ordinary * q / F.col("count_over")
    will_do = F.when((F.col("count_over") > 0) & (wrong <= fdr), F.col("t") / BINS)
    return over.groupBy("enc", "class").agg(F.min(will_do).alias("threshold")).where("threshold is not null")


def _random(limits: list) -> Column:
    """Spans of the candidates over their class's threshold; ``limits`` are rows of ``thresholds``."""
    if not limits:
        return _none(f"array<{SPAN}>")
    table = F.create_map(*[F.lit(x) for r in limits for x in (f"{r['enc']}{r['class']}", float(r["threshold"]))])
    key = lambda c: F.concat(c["enc"], _length_class(c["n"]).cast("string"))
    return _spans(F.filter("_candidates", lambda c: F.coalesce(c["p"] > F.try_element_at(table, key(c)), F.lit(False))), 3)


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``secret_spans`` array<struct<kind, start, stop>>, one row per row.

    Spans are in code points, the end exclusive, ordered by start, then kind (a place in ``KINDS``). Texts are
    read once: spans and p-values are stored, class thresholds come from all of them, and at most 93 go
    to the driver. Null and empty texts have no spans; repeated rows stay; an empty table gives no rows.
    """
    scanned = stored(scan(docs, text).select(*keep, "_base", "_candidates"), "secrets")
    limits = thresholds(scanned, fdr).collect()
    return scanned.select(*keep, _ordered(F.concat("_base", _random(limits))).alias("secret_spans"))


def _ordered(spans: Column) -> Column:
    by_start = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.transform(
        F.sort_array(by_start), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; all rows and columns stay.

    Overlapping spans become one mask. Texts are read twice, once for the thresholds and once to cut, so
    that no text is shuffled or stored. A null text stays null.
    """
    limits = thresholds(stored(scan(docs, text).select("_candidates"), "secrets"), fdr).collect()
    found = scan(docs, text).withColumn("_spans", _ordered(F.concat("_base", _random(limits))))

    def merge(acc: Column, s: Column) -> Column:
        inside = F.size(acc) > 0
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        own = F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return (
            F.when(~inside, own).when(s["start"] <= last["stop"], F.concat(head, F.array(joined))).otherwise(F.concat(acc, own))
        )

    merged = F.aggregate("_spans", _none("array<struct<start:int,stop:int>>"), merge)
    # Four bytes a code point, so that a cut does not walk the text from its start.
    wide = F.encode(F.col(text), "UTF-32")

    def cut(acc: Column, s: Column) -> Column:
        kept = F.substring(acc["wide"], acc["at"] * 4 + 1, (s["start"] - acc["at"]) * 4)
        piece = F.array(F.concat(F.decode(kept, "UTF-32"), F.lit(mask)))
        return F.struct(acc["wide"].alias("wide"), s["stop"].alias("at"), F.concat(acc["out"], piece).alias("out"))

    def close(acc: Column) -> Column:
        rest = F.substring(acc["wide"], acc["at"] * 4 + 1, F.octet_length(acc["wide"]))
        return F.concat(F.array_join(acc["out"], ""), F.decode(rest, "UTF-32"))

    start = F.struct(wide.alias("wide"), F.lit(0).alias("at"), _none("array<string>").alias("out"))
    cleaned = F.when(F.size("_spans") == 0, F.col(text)).otherwise(F.aggregate(merged, start, cut, close))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), cleaned)).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``find_secrets``, in the columns of the query."""

    def joined(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(parts, ",")

    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(i) for i, k in enumerate(KINDS)}
    return found.select(
        "doc_id",
        *(counts[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        counts["n_random"].alias("n_random"),
    )
