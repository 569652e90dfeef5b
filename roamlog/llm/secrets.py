"""Secret scan: candidates by pattern, a random forest to remove false positives. DataFrame functions only.

Candidates are runs of at least 16 key-like characters with a digit, quoted values of at least 8 characters after = or :,
unquoted ones after = or : and the name of a credential, and strings of a known key's shape. The forest judges a candidate
by its length, character classes and transitions, how much of it a dictionary covers, its path and the neighbouring words.
The dictionary is made of the words that stand by themselves in all documents.

The forest learns from labelled findings (id, start, is_secret); at most ``TRAIN_ROWS`` of them, chosen by a hash of
their place, are used. Each kind has half of these rows, and what the other leaves; weights keep the shares of the kinds.
Where no findings are given, :func:`evident_findings` labels the candidates that leave no doubt, for training only: the
forest's votes decide every candidate. It also learns from each evident secret without its surroundings (a key is one
wherever it is pasted) and called a hash (such a run is none). With given findings of one kind only every candidate gets that kind. Where there is nothing to
tell the kinds apart by, nothing can be removed: every candidate that has no label counts as a secret.

Null and empty texts have no candidates. Rows that repeat an id are told apart by their text; equal rows give equal
findings, each once per row. A null path counts as an empty one.
"""
from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlog.llm.common import bounded_sample, query, table, with_row_key
from roamlog.session import stage

#: Most labelled findings the forest is fitted on.
TRAIN_ROWS = 20_000
#: Characters of context kept on each side of a candidate.
CONTEXT = 64
#: Times a word is seen in the documents before it is in the dictionary.
DICTIONARY_COUNT = 3
REDACTED = "<SECRET>"

#: Keys that are told by their shape, wherever they stand.
KEY_SHAPE = (r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"
             r"|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
             r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
CANDIDATE = (r"(?<![A-Za-z0-9+/_-])(?:" + KEY_SHAPE + r"|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2})"
             r"""|(?<=["'])(?<=[=:][ \t]{0,3}["'])[^"'\s]{8,}(?=["'])"""
             # The short tests come first: the long one looks back at few places only.
             r"""|(?<=[=: \t])(?<=[=:][ \t]{0,3})(?<=(?i:secret|token|passw|password|passwd|passphrase|pwd|key|credentials?|auth)[ \t]{0,3}[=:][ \t]{0,3})"""
             r"""[^\s"'<>,;&]{7,}[^\s"'<>,;&.:!?)\]}]""")
CREDENTIAL_WORD = r"(?i)(secret|token|passw|pwd|passphrase|credential|api.?key|access.?key|private.?key|auth|bearer)"
HASH_WORD = r"(?i)(sha-?\d|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|fingerprint|\bid\b)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|change.?me|x{4}|your[_-]|redacted|fake|1234567|abcdef)"
#: The same near a candidate, where host names and addresses do not count.
PLACEHOLDER_WORD = r"(?i)(?<![\w.@-])(example|sample|dummy|placeholder|redacted|fake)(?![\w.@-])"
TEST_PATH = r"(?i)(test|example|sample|fixture|docs?\b|mock)"
CODE_PATH = r"(?i)\.(env|cfg|conf|ini|ya?ml|json|toml|properties|py|js|java|go|rb|sh|tf)$"

FEATURES = ["length", "digits", "uppers", "lowers", "hex", "class_changes", "case_changes", "distinct", "dictionary",
            "shape", "assigned", "quoted", "credential", "hash_word", "placeholder", "in_url", "test_path", "code_path"]
#: Those of them that tell where a candidate stands.
SURROUNDINGS = ["assigned", "quoted", "credential", "hash_word", "in_url", "test_path", "code_path"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(_key, _row, id, path, k, start, value, before, after) of every candidate; ``start`` counts characters from 0."""
    rows = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.col(text).alias("text")), "id", "text")
    held = rows.filter(F.col("text").rlike(CANDIDATE)).withColumn("_row", F.monotonically_increasing_id())
    # The text between matches gives the contexts and, summed up, the positions.
    cut = held.select("_key", "_row", "id", "path", F.split("text", CANDIDATE, -1).alias("gaps"),
                      F.posexplode_outer(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("k", "value"))
    gap, after = F.get("gaps", F.col("k")), F.get("gaps", F.col("k") + 1)
    narrow = stage(cut.filter("value IS NOT NULL").select(
        "_key", "_row", "id", "path", "k", "value", F.length(gap).cast("long").alias("gap"),
        F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after")), "candidates")
    earlier = Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("value")).over(earlier), F.lit(0)) + F.col("gap")
    return narrow.withColumn("start", start).drop("gap")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part): the words of a-z that stand by themselves in the texts, ``DICTIONARY_COUNT`` times at least."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"""[\s.,;:!?()\[\]{}<>"']+""")).alias("part"))
    return words.filter(F.col("part").rlike("^[a-z]{3,}$")).groupBy("part").agg(F.count("*").alias("n")).filter(
        F.col("n") >= DICTIONARY_COUNT).select("part")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``. ``found`` is a staged table, ``words`` a dictionary."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    parts = found.select("_row", "k", F.explode(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0))).alias("part"))
    covered = parts.join(words, "part").groupBy("_row", "k").agg(F.sum(F.length("part")).alias("covered"))
    near = F.concat(F.substring(before, -40, 40), F.lit(" "), F.substring(after, 1, 20))
    return found.join(covered, ["_row", "k"], "left").select(
        *found.columns, F.length(v).cast("double").alias("length"), _share(v, "[0-9]").alias("digits"),
        _share(v, "[A-Z]").alias("uppers"), _share(v, "[a-z]").alias("lowers"), _share(v, "[0-9a-fA-F]").alias("hex"),
        _share(v, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])").alias("class_changes"),
        _share(v, "[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("case_changes"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / F.length(v)).alias("dictionary"),
        _flag(v.rlike("^(?:" + KEY_SHAPE + ")")).alias("shape"),
        _flag(before.rlike(r"""[=:]\s*["']?$""")).alias("assigned"),
        _flag(before.rlike(r"""["']$""") & after.rlike(r"""^["']""")).alias("quoted"),
        _flag(F.substring(before, -40, 40).rlike(CREDENTIAL_WORD)).alias("credential"),
        _flag(near.rlike(HASH_WORD)).alias("hash_word"), _flag(near.rlike(PLACEHOLDER_WORD) | v.rlike(PLACEHOLDER)).alias("placeholder"),
        _flag(before.rlike(r"(https?://|www\.)\S*$")).alias("in_url"),
        _flag(path.rlike(TEST_PATH)).alias("test_path"), _flag(path.rlike(CODE_PATH)).alias("code_path"))


def evident(rows: DataFrame) -> DataFrame:
    """Adds ``evident``: true for known shapes and what is assigned to a credential's name, false for placeholders, numbers,
    words, and what is called a hash or id; null for all else, such as a key in plain text."""
    v, bare = F.col("value"), (F.col("credential") == 0) & (F.col("assigned") == 0)
    whole = F.col("shape") > 0
    named = (F.col("credential") > 0) & (F.col("assigned") > 0) & (F.col("placeholder") == 0) & (F.col("dictionary") < 0.5) & (
        (F.col("quoted") > 0) | (F.col("digits") > 0))
    called = (F.col("credential") == 0) & (F.col("hash_word") > 0)
    plain = bare & (v.rlike("^[0-9+/_-]+$") | (F.col("dictionary") >= 0.5))
    return rows.withColumn("evident", F.when(v.rlike(PLACEHOLDER), False).when(whole | named, True).when(called | plain, False))


def evident_findings(rows: DataFrame) -> DataFrame:
    """The labels of :func:`evident` as findings."""
    return evident(rows).select("id", "start", F.col("evident").alias("is_secret")).filter("is_secret IS NOT NULL")


def training_rows(known: DataFrame, rows: int) -> DataFrame:
    """(_key, start, label, FEATURES, weight): at most ``rows`` findings, both kinds among them if both are known."""
    found = stage(known.groupBy("_key", "start", "label", *FEATURES).agg(F.count("*").alias("copies")), "known")
    totals = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    parts = []
    for label, total in sorted(totals.items()):
        most = max(rows // 2, rows - (sum(totals.values()) - total), 1)
        weight = F.col("copies") * F.lit(max(total / most, 1.0))
        part = bounded_sample(found.filter(F.col("label") == label), most, "_key", "start", *FEATURES, total=total)
        parts.append(part.withColumn("weight", weight).drop("copies"))
    return reduce(DataFrame.unionByName, parts) if parts else found.withColumn("weight", F.lit(1.0)).drop("copies")


def judged(rows: DataFrame, findings: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 40, depth: int = 6,
           bare: bool = False) -> DataFrame:
    """Adds ``score`` (the forest's share of votes for a secret) and ``is_secret``. ``rows`` is a staged table.

    With ``bare`` the forest also learns from each secret without its surroundings, and called a hash."""
    labels = findings.filter("is_secret IS NOT NULL").groupBy("id", "start").agg(
        F.min(F.col("is_secret").cast("double")).alias("label"), F.max(F.col("is_secret").cast("double")).alias("other")).filter(
        "label = other").select(F.col("id").alias("_id"), F.col("start").alias("_start"), "label")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start"))
    known = rows.join(labels, same).select("_key", "start", "label", *FEATURES)
    sample = stage(training_rows(known, train_rows).coalesce(1), "findings")
    kinds = sorted(r.label for r in sample.select("label").distinct().collect())
    if len(kinds) < 2:
        # Evident findings that are all false say nothing about the candidates left without a label.
        score = F.lit(kinds[0] if kinds and not (bare and kinds == [0.0]) else None).cast("double")
        return rows.withColumn("score", score).withColumn("is_secret", F.coalesce(score >= 0.5, F.lit(True)))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=5,
                                    probabilityCol="_votes", rawPredictionCol="_raw", predictionCol="_guess")
    if bare:
        def placed(**features: float) -> list[Column]:
            fixed = {**dict.fromkeys(SURROUNDINGS, 0.0), **features}
            return [F.lit(fixed[c]).alias(c) if c in fixed else F.col(c) for c in sample.columns]

        secret = sample.filter("label = 1")
        sample = sample.unionByName(secret.select(*placed())).unionByName(
            secret.filter("shape = 0").select(*placed(hash_word=1.0, label=0.0)))
    model = forest.fit(vector.transform(sample))
    scored = model.transform(vector.transform(rows)).withColumn("score", F.round(vector_to_array("_votes")[1], 9))
    return scored.drop("_features", "_votes", "_raw", "_guess").withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
         path: str = "source") -> DataFrame:
    """Per candidate: ``_key``, ``id_col``, ``start``, ``n_chars``, ``value``, ``score`` and ``is_secret``."""
    rows = stage(described(candidates(docs, id_col, text, path), dictionary(docs, text)), "described")
    if findings is None:
        scored = judged(rows, evident_findings(rows), bare=True)
    else:
        scored = judged(rows, findings)
    return scored.select("_key", F.col("id").alias(id_col), "start", F.length("value").cast("long").alias("n_chars"), "value",
                         "score", "is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
           path: str = "source", size: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``REDACTED``; ``size``, if it is a column, is the new length of such texts."""
    spans = scan(docs, findings, id_col, text, path).filter("is_secret").select("_key", "start", "n_chars").distinct()
    spans = stage(spans.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "n_chars"))).alias("_spans")), "spans")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(id_col, text).alias("_key"), F.col(text).alias("_old")).join(
        spans, "_key", "left")
    kept = F.expr("""transform(_spans, (s, i) -> substring(_old,
        int(if(i = 0, 0, _spans[i - 1].start + _spans[i - 1].n_chars)) + 1,
        int(s.start - if(i = 0, 0, _spans[i - 1].start + _spans[i - 1].n_chars))))""")
    last = F.expr("substring(_old, int(element_at(_spans, -1).start + element_at(_spans, -1).n_chars) + 1)")
    rows = rows.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("_old")).otherwise(
        F.array_join(F.concat(kept, F.array(last)), REDACTED)))
    out = {text: F.col("_new")}
    if size in docs.columns:
        out[size] = F.when(F.col("_spans").isNull(), F.col(f"row.{size}")).otherwise(
            F.length("_new").cast(docs.schema[size].dataType))
    return rows.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@query("op1_secret_scan")
def _(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("_key")
