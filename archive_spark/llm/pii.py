r"""Personal data by base patterns and candidate gradient boosting, in DataFrame functions only.

Base spans are what the fixed patterns match and the fixed checks accept; they always stay. High-recall generators
propose further, overlapping candidates. Boosted trees read each candidate's format and context. They are fitted here:
a candidate is positive if a valid base span of its kind touches it, or if its plain form (written-out signs put back,
odd separators taken out) passes the checks; each positive one that the base found also counts in the forms that the
generators are for (`name (at) host dot org`, digits parted by dots, 00 for +), in its own context. Thresholds per kind are calibrated on held-out candidates; candidates beyond them that touch no base span are added, the most
probable first where they overlap. The fitted trees are plain `when` expressions inside the projection that scores.

Defined results: null and empty texts have no spans; repeated rows are judged one by one; with no labelled candidates
of both classes no span is added; an empty table gives an empty result. Offsets are in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive and with guards against starting inside a run that has failed: the same
#: matches, in linear time and without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: High-recall generators: written-out e-mail addresses, addresses with odd separators, grouped digits, national numbers.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:@|\(at\)|\[at\]) ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:[.,] ?[0-9]{1,4}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}+",
    "phone": r"(?:\+|00|(?<![0-9]))[0-9(][\x20()./0-9-]{6,20}[0-9]",
}
#: The pattern of written-out addresses is tried on texts with "@", "(at)" or "[at]".
CANDIDATE_NEEDS = {"email": ("@", "(at)", "[at]"), "ip": None, "card": None, "phone": None}
CONTEXT = 24
_CUES = r"(?i)(mail|tel|phone|call|fax|mobil|card|visa|credit|pay|addr|host|server|contact)"
FEATURES = ("kind", "chars", "digits", "letters", "dots", "blanks", "hyphens", "plus", "longest_run", "luhn", "octets", "inner", "cue", "written", "abroad")
_AT, _DOT = r" ?(?:\(at\)|\[at\]) ?", r" ?\[dot\] ?| ?\(dot\) ?| dot "
#: Trees and their depth, and the least precision on held-out candidates.
TREES, DEPTH, PRECISION = 8, 3, 0.99
_GRID = tuple(0.5 + 0.05 * i for i in range(10))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(text: Column) -> Column:
    """Whether the digits of a text pass Luhn's check; for short texts."""
    digits = F.reverse(_digits(text))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def value(i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(at, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The checks that a base match must pass."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(12, 19), luhn_ok(match)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _matches(text: Column, pattern: str, need: str | tuple[str, ...] | None) -> Column:
    if need is None:
        some = text.rlike("[0-9]")
    else:
        some = reduce(or_, [F.contains(text, F.lit(x)) for x in ([need] if isinstance(need, str) else need)])
    return F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))


def _between(text: Column, pattern: str, matches: Column) -> Column:
    """The texts around the matches; the pattern is applied again only where it has matched."""
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _placed(matches: Column, between: Column) -> Column:
    """start, end and text of each match."""
    spans = "array<struct<start:int,end:int,text:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(a: Column, i: Column) -> Column:
        start = a["at"] + F.length(F.element_at(between, i))
        match = F.element_at(matches, i)
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), match.alias("text")))).alias("out"))

    found = F.aggregate(F.sequence(F.lit(1), F.size(matches)), begin, step)["out"]
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(spans))


def _find(df: DataFrame, patterns: dict[str, str], prefix: str, needs: dict) -> DataFrame:
    """Adds a column of placed matches for each kind. Each step is a projection of its own, so no pattern runs twice."""
    text = F.col("_text")
    df = df.withColumns({f"{prefix}{k}_m": _matches(text, p, needs[k]) for k, p in patterns.items()})
    df = df.withColumns({f"{prefix}{k}_b": _between(text, p, F.col(f"{prefix}{k}_m")) for k, p in patterns.items()})
    df = df.withColumns({f"{prefix}{k}": _placed(F.col(f"{prefix}{k}_m"), F.col(f"{prefix}{k}_b")) for k, p in patterns.items()})
    return df.drop(*[f"{prefix}{k}_{x}" for k in patterns for x in "mb"])


def _is_valid(kind: str, s: Column) -> Column:
    return valid(kind, s["text"])


def _span(kind: int, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def base_spans(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _text (not null), and _base: the valid base spans (start, kind, end), sorted by start, then kind."""
    df = _find(documents.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))), BASE, "_base_", NEEDS)
    parts = []
    for k in KINDS:
        good = F.filter(f"_base_{k}", partial(_is_valid, k))
        parts.append(F.transform(good, partial(_span, KINDS.index(k))))
    return df.withColumn("_base", F.array_sort(F.concat(*parts))).drop(*[f"_base_{k}" for k in KINDS])


def _features(text: Column, kind: int, start: Column, end: Column, match: Column) -> list[Column]:
    count = lambda p: F.length(F.regexp_replace(match, p, ""))
    before = F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
    near = F.concat(F.right(before, F.lit(1)), F.lit(" "), F.substring(text, end + 1, F.lit(1)))
    run = F.array_max(F.transform(F.split(match, "[^0-9]+", -1), lambda x: F.length(x)))
    values = (
        F.lit(kind), F.length(match), count("[^0-9]"), count("[^A-Za-z]"), count("[^.]"), count("[^ ]"), count("[^-]"), count("[^+]"), run,
        F.when(F.length(_digits(match)).between(12, 19), luhn_ok(match).cast("int")).otherwise(-1), match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$").cast("int"),
        near.rlike("[A-Za-z0-9]").cast("int"), before.rlike(_CUES).cast("int"), match.rlike(_AT).cast("int"), match.rlike(r"^(?:\+|00)[0-9\x20(]").cast("int"),
    )
    return [v.cast("double") for v in values]


def plain_valid(kind: str, match: Column) -> Column:
    """Whether a candidate's plain form passes its kind's checks: a source of labels that needs no base match."""
    if kind == "email":
        return match.rlike(_AT) & F.regexp_replace(F.regexp_replace(match, _AT, "@"), _DOT, ".").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
    if kind == "ip":
        return ~F.contains(match, F.lit(",")) & match.rlike("^[0-9]{2,3}[.]") & valid("ip", F.regexp_replace(match, r"[.] ?", "."))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(13, 19) & match.rlike("^[0-9]{4}"), luhn_ok(match)).otherwise(F.lit(False))
    return match.rlike("^00[0-9\\x20(]") & (n - 2).between(9, 15)


def rewritten(kind: str, match: Column) -> Column:
    """A base span in a form that only the generators take."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(match, "@", " (at) "), "[.](?=[A-Za-z0-9-]*$)", " dot ")
    if kind == "ip":
        return F.regexp_replace(match, "[.]", ". ")
    return F.regexp_replace(match, "[ -]", ".") if kind == "card" else F.regexp_replace(match, "^[+]", "00")


def _candidate(kind: int, fitting: bool, s: Column) -> Column:
    touch = lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])
    label = F.exists("_base", lambda b: touch(b) & (b["kind"] == kind))
    of = lambda match: F.array(*_features(F.col("_text"), kind, s["start"], s["end"], match))
    found = [s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), (~F.exists("_base", touch)).alias("free"), of(s["text"]).alias("features")]
    if fitting:
        found += [(label | plain_valid(KINDS[kind], s["text"])).cast("int").alias("label"), F.when(label, of(rewritten(KINDS[kind], s["text"]))).alias("rewritten")]
    return F.struct(*found)


def candidates(based: DataFrame, fitting: bool = False) -> DataFrame:
    """Adds _candidates: start, kind, end, free (no base span overlaps it), features; for fitting also label, and the features
    of the rewritten form where a base span of the kind overlaps it."""
    df = _find(based, GENERATORS, "_cand_", CANDIDATE_NEEDS)
    parts = [F.transform(f"_cand_{k}", partial(_candidate, i, fitting)) for i, k in enumerate(KINDS)]
    return df.withColumn("_candidates", F.concat(*parts)).drop(*[f"_cand_{k}" for k in KINDS])


@dataclass
class Booster:
    """Trees as nested (feature, threshold, left, right) or leaf values, their weights, and a threshold per kind."""

    trees: list
    weights: list[float]
    thresholds: list[float]

    def margin(self, features: Column) -> Column:
        def read(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(F.element_at(features, at + 1) <= threshold, read(left)).otherwise(read(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + F.lit(weight) * read(tree)
        return total

    def probability(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(features)))


def _tree(node):
    """A fitted tree's nodes as plain values."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def labelled(found: DataFrame) -> DataFrame:
    """label, held, features and weight: every candidate and rewritten form of all documents (with candidates(..., fitting=True)),
    equal ones as one row whose weight is their number, so that what is kept grows with the kinds of candidates only. A fifth is held out."""
    rows = found.select(F.explode("_candidates").alias("c"))
    both = F.filter(F.array(F.struct("c.label", "c.features"), F.struct(F.lit(1).alias("label"), F.col("c.rewritten").alias("features"))), lambda x: x["features"].isNotNull())
    rows = rows.select("c.start", F.inline(both)).withColumn("held", F.pmod(F.xxhash64("features", "start"), F.lit(5)) == 0)
    return rows.groupBy(F.col("label").cast("double").alias("label"), "held", "features").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def train(found: DataFrame, max_train: int | None = None) -> Booster | None:
    """Fits on every candidate of all documents (with candidates(..., fitting=True)), or on max_train kinds of them, those with
    the smallest hash, if a caller gives that."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled(found)
    if max_train is not None:
        rows = rows.orderBy(F.xxhash64("features"), "label", "held").limit(max_train)
    rows = rows.select("label", "held", "weight", *[F.element_at("features", i + 1).alias(c) for i, c in enumerate(FEATURES)]).cache()
    try:
        fit, held = rows.where("not held"), rows.where("held")
        if len(fit.select("label").distinct().collect()) < 2:
            return None
        spread = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(spread.transform(fit))
        trees = [_tree(t.rootNode()) for t in model._java_obj.trees()]
        booster = Booster(trees, list(model.treeWeights), [2.0] * len(KINDS))
        p = booster.probability(F.array(*FEATURES))
        counts = [F.sum(F.when(F.col("p") >= t, F.col("weight"))).alias(f"n{i}") for i, t in enumerate(_GRID)] + [F.sum(F.when(F.col("p") >= t, F.col("label") * F.col("weight"))).alias(f"y{i}") for i, t in enumerate(_GRID)]
        for row in held.withColumn("p", p).groupBy("kind").agg(*counts).collect():
            good = [t for i, t in enumerate(_GRID) if row[f"n{i}"] and row[f"y{i}"] >= PRECISION * row[f"n{i}"]]
            booster.thresholds[int(row["kind"])] = min(good, default=2.0)
        return booster
    finally:
        rows.unpersist()


def find_personal_data(documents: DataFrame, *, text_col: str = "text", max_train: int | None = None, store: bool = False) -> DataFrame:
    """Adds _base and _added (start, kind, end), both sorted, to the documents (and _text). store: candidates are written once
    with the documents and read again to be scored, else they are found twice."""
    based = base_spans(documents, text_col)
    kind_of = "array<struct<start:int,kind:int,end:int>>"
    booster, found = None, based
    if max_train is None or max_train > 0:
        found = candidates(based, fitting=True)
        if store:
            spark = documents.sparkSession
            found.drop("_text").write.parquet(path := shared_path(spark, "personal-data"))
            found = spark.read.parquet(path).withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
        booster = train(found, max_train)
    if booster is None:
        return found.drop("_candidates").withColumn("_added", F.array().cast(kind_of))
    limits = F.array(*[F.lit(t) for t in booster.thresholds])
    scored = F.transform(
        F.filter("_candidates", lambda c: c["free"]),
        lambda c: F.struct(booster.probability(c["features"]).alias("p"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )
    df = (found if store else candidates(based)).withColumn("_scored", F.filter(scored, lambda c: c["p"] >= F.element_at(limits, c["kind"] + 1)))

    def best(c: Column) -> Column:
        rank = lambda x: F.struct(x["p"], -x["start"], -x["kind"], x["end"])
        return ~F.exists("_scored", lambda o: (o["start"] < c["end"]) & (o["end"] > c["start"]) & (rank(o) > rank(c)))

    added = F.transform(F.filter("_scored", best), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return df.withColumn("_added", F.array_sort(added)).drop("_scored", "_candidates")


def _of_kind(kind: int, s: Column) -> Column:
    return s["kind"] == kind


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int | None = None) -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    found = find_personal_data(documents.select(F.col(id_col), F.col(text_col)), text_col=text_col, max_train=max_train, store=True)
    counts = [F.size(F.filter("_base", partial(_of_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("_base", "_added"))
    return found.select(F.col(id_col), *counts, F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(every).alias("spans"))


def redact(documents: DataFrame, *, text_col: str = "text", max_train: int | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns stay. A null text stays null."""
    found = find_personal_data(documents, text_col=text_col, max_train=max_train)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.concat(F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    done = F.aggregate(F.array_sort(F.concat("_base", "_added")), begin, step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    text = F.when(F.col(text_col).isNotNull(), done).alias(text_col)
    return found.select(*[text if c == text_col else F.col(c) for c in documents.columns])
