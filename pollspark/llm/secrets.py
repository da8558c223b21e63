"""Secret scan with a random forest that removes false positives, in DataFrame and Spark ML operations only.

Candidates are runs of 16 or more letters, digits and the signs of keys, and, right after an announcing word and
``:`` or ``=``, any run of 4 or more characters that are not blank. Their features: length; shares of
digits, capitals and vowels; changes between kinds of characters; coverage by the corpus's own frequent words;
signs of a path; words in front that announce a secret. The forest is trained on labelled findings. A caller
passes them as (id, candidate, label); without them findings are labelled by form: keys of a known form and
announced values with digits are secrets; short words, and plain runs, numbers and paths without announcement are not. At most
``train_rows`` findings (those of least hash) train it; words and scores cover all documents.

Results for unusual input: null and empty texts have no findings; if the labels hold one class only, the
label itself is the score; equal candidates in equal surroundings score equally; repeated rows give repeated
findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pollspark.llm.common import stored

LONG_RUN = r"[A-Za-z0-9_+/-]{16,}={0,2}"
# A value right after an announcing word and : or =, in quotes up to the next one. The first two lookbehinds are cheap and implied.
WORDS = r"api|access|secret|private|auth|pass|passwd|password|pwd|token|bearer|credential|key"
VALUE_BEHIND = r"(?<=[:=\s\"'])(?<=[:=]\s{0,3}[\"']?)(?<=(?i:" + WORDS + r")[A-Za-z_ -]{0,12}[\"']?\s{0,3}[:=]\s{0,3}"
CANDIDATE = rf"{VALUE_BEHIND}[\"'])[^\s\"']{{4,}}|{VALUE_BEHIND})[^\s\"':=]\S{{3,}}|{LONG_RUN}"
# Words that announce a secret, and keys of known forms (fixed values).
ANNOUNCED = r"(?i)(" + WORDS + r")[a-z_ -]{0,12}[\"']?\s*[:= ]\s*[\"']?$"
KNOWN_FORM = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})$"
CONTEXT = 40  # characters before and after a candidate
FREQUENT_WORDS = 300
TRAIN_ROWS = 20_000
FEATURES = ["length", "digits", "capitals", "vowels", "changes", "coverage", "path", "announced", "assigned", "known"]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nth, start, candidate, before, after) of every candidate in the whole texts; start counts characters from 1."""
    text = F.col("text")
    hit = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(text.rlike(CANDIDATE))
    cut = hit.select("id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE).alias("between"))
    pieces = F.zip_with("between", "found", lambda b, c: F.concat(b, F.coalesce(c, F.lit(""))))
    cut = cut.withColumn("pieces", pieces)
    each = cut.select("id", "between", "pieces", F.posexplode("found").alias("nth", "candidate"))
    at = F.col("nth")
    ends = F.aggregate(F.slice("pieces", F.lit(1), at), F.lit(0), lambda a, x: a + F.length(x))
    # Words around a candidate are those of the text, so pieces next to it count with their own candidates.
    near = F.least(at, F.lit(CONTEXT))
    between = F.element_at("between", at + 1)
    before = F.concat(F.array_join(F.slice("pieces", at + 1 - near, near), ""), between)
    after = F.array_join(F.slice("pieces", at + 2, F.lit(CONTEXT)), "")
    return each.select("id", "nth", (ends + F.length(between) + 1).alias("start"), "candidate",
                       F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))


def frequent_words(docs: DataFrame, text_col: str = "text", top: int = FREQUENT_WORDS) -> DataFrame:
    """One row with ``frequent``: the most frequent words of 3 or more letters over all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
    return counted.agg(F.collect_list("word").alias("frequent"))


def features(found: DataFrame, frequent: DataFrame) -> DataFrame:
    c, length = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(c, pattern, "")) / length

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001\u0002\u0003]+", "\u0004")
    covered = F.aggregate("frequent", F.lit(0), lambda a, w: a + F.when(F.contains(F.lower(c), w), F.length(w)).otherwise(0))
    return found.crossJoin(F.broadcast(frequent)).withColumns({
        "length": length.cast("double"), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "vowels": share("[^aeiouAEIOU]"),
        "changes": (F.length(kinds) - 1) / length, "coverage": F.least(F.lit(1.0), covered / length),
        "path": (c.contains("/") | F.col("before").rlike(r"(://|/|\\)\S*$") | F.col("after").rlike(r"^\.[a-z]{2,4}\b")).cast("double"),
        "announced": F.col("before").rlike(ANNOUNCED).cast("double"), "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "known": c.rlike(KNOWN_FORM).cast("double"),
    }).drop("frequent")


def by_form() -> Column:
    """Label of a finding by its form alone: 1, 0, or null where the form does not tell."""
    secret = (F.col("known") == 1) | ((F.col("announced") == 1) & (F.col("digits") > 0))
    word = F.col("candidate").rlike(r"^[A-Za-z]?[a-z]{0,14}[.,;!?)]*$")  # a short word of the language, as in "key: value"
    plain = word | ((F.col("announced") == 0) & ((F.col("digits") == 0) | (F.col("digits") == 1) | (F.col("path") == 1)))
    return F.when(secret, 1.0).when(plain, 0.0)


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, train_rows: int = TRAIN_ROWS, threshold: float = 0.5,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, finding_sha256, score, is_secret) of every candidate."""
    found = stored(features(findings(docs, id_col, text_col), frequent_words(docs, text_col)), "findings")
    if labelled is None:
        train = found.withColumn("label", by_form()).where("label IS NOT NULL")
    else:
        given = labelled.select(F.col(id_col).alias("id"), "candidate", F.col("label").cast("double").alias("label")).distinct()
        train = found.join(given, ["id", "candidate"])
    # A bounded sample, half of it for each label, by least hash.
    mixed = F.xxhash64("candidate", "before")
    train = train.withColumn("mixed", mixed)
    sample = stored(train.where("label = 1").orderBy("mixed", "id", "start").limit(train_rows // 2)
                    .unionByName(train.where("label = 0").orderBy("mixed", "id", "start").limit(train_rows // 2)), "labelled-findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features")
    digest = [F.col("id").alias(id_col), "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("finding_sha256")]
    if sample.select("label").distinct().count() < 2:
        score = F.coalesce(by_form(), F.lit(0.0))
        return found.withColumn("score", score).select(*digest, "score", (F.col("score") > threshold).alias("is_secret"))
    forest = RandomForestClassifier(numTrees=20, maxDepth=6, seed=11, featuresCol="features", labelCol="label")
    model = forest.fit(rows.transform(sample.orderBy("mixed", "id", "start")))
    scored = model.transform(rows.transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*digest, "score", (F.col("score") > threshold).alias("is_secret"))
