"""Line dedup with a fixed-depth log-template tree.

A line's leaf is its token count and its leading tokens, with tokens that hold digits read as a
variable field. What follows in a leaf is cut into runs of tokens, each of at most a tenth of the line (one
token at least). A template is a leaf with at most two runs left open, so that at least `similarity`
of the positions are fixed; a line belongs to all templates that it fits, and to the one of all its tokens.
A template that occurs in `min_docs` documents or more recurs, and its lines are dropped. A line is dropped only for a line
that stays and shares a recurring template with it: going by the lines' first documents (by doc_id, then the text's hash), a
form (a line as masked) stays if no form before it that stays shares such a template with it, and of a form that stays the lines in its first
document stay. So no passage is lost: every dropped line has a kept one of which it shares the fixed positions of a template, however
long a chain of ever more different lines is.

Whether forms stay is found in rounds: a form that is the first of all undecided ones of each of its templates stays, forms that
share a template with one that stays go, and so on. After ORDERED_ROUNDS of them, which only long chains of lines need, what is still
undecided is ordered by hash, so that the rounds left grow with the logarithm of their number. Each round takes minima per
template, so no leaf or template is gathered in one place. A line gives a bounded number of templates; only lines that share a third of their runs with another line of the
leaf, as two of one template must, give any but their own form.

Lines of fewer than MIN_TOKENS tokens, too short for a variable field, recur as exactly the same tokens
only. They are looked at where `min_tokens` is smaller, as the query and the pipeline have it.

Edge cases: null text counts as empty; lines of fewer than `min_tokens` tokens stay, and so do lines
without a token; a line repeated
inside one document only is not a recurring one; rows without doc_id are left as they are; a document is a distinct
(doc_id, text), so that rows sharing an id with other texts are documents of their own, and equal rows are one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetide.llm.common import discard, saved, text_or_empty

DEPTH = 4
SIMILARITY = 0.8
MIN_DOCS = 2
MIN_TOKENS = 4
#: Runs that a template may leave open.
FIELDS = 2
FIELD = "<*>"
#: Rounds in which lines go by the order of documents.
ORDERED_ROUNDS = 16


def run_length(n: int, similarity: float) -> int:
    """Tokens in a run of a line of n tokens: FIELDS runs leave at least the share `similarity` fixed, or one run if a field of one token is all there is room for; 0: none."""
    open_tokens = int((1 - similarity) * n + 1e-9)
    return max(1, open_tokens // FIELDS) if open_tokens else 0


def text_hash() -> Column:
    """With doc_id, what names a document."""
    return F.xxhash64(text_or_empty())


def parsed_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, text_hash, line_no, n (tokens), leaf, form (the line, masked; both as hashes), runs (hashes of the runs after the
    leading tokens; empty where the line has no room for a field) of every line long enough."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, line_no int, n int, leaf long, form long, runs array<long>"

    def run(batches):
        digit, hashed, mask = re.compile(rb"[0-9]"), xxhash.xxh3_64_intdigest, FIELD.encode()
        for batch in batches:
            rows, line_no, count, leaf, form, runs, ends = [], [], [], [], [], [], [0]
            for at, text in enumerate(batch.column("text").to_pylist()):
                for number, line in enumerate((text or "").encode().split(b"\n")):
                    tokens = line.split()  # bytes know ASCII white space only
                    n = len(tokens)
                    if n == 0 or n < min_tokens:
                        continue
                    if n >= MIN_TOKENS and digit.search(line):
                        tokens = [mask if digit.search(t) else t for t in tokens]
                    rows.append(at)
                    line_no.append(number)
                    count.append(n)
                    leaf.append(hashed(b" ".join(tokens[:depth]), n))
                    form.append(hashed(b" ".join(tokens)))
                    step = run_length(n, similarity) if n >= MIN_TOKENS else 0
                    if step:
                        runs.extend(hashed(b" ".join(tokens[i : i + step]), i) for i in range(depth, n, step))
                    ends.append(len(runs))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            at = pa.array(rows, pa.int64())
            columns = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(line_no, pa.int32()), pa.array(count, pa.int32()), signed(leaf), signed(form)]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(runs)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "line_no", "n", "leaf", "form", "runs"])

    return docs.where("doc_id is not null").select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, schema)


def shared_templates(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node (of leaf and form), template of the lines of met (leaf, form, n, runs) whose form shares a template with another form of its leaf."""
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    size = F.size("runs")
    # the runs in three parts: two open runs leave one part as it is
    part = lambda k: F.slice("runs", 1 + (size * k / 3).cast("int"), (size * (k + 1) / 3).cast("int") - (size * k / 3).cast("int"))
    parts = F.array(*[F.xxhash64("leaf", F.lit(k), part(k)) for k in range(3)])
    several = met.where(size > 0).select("leaf", "form", "n", "runs", parts.alias("parts"))
    cut = several.select("form", F.explode("parts").alias("part"))
    alike = saved(cut.groupBy("part").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("part"), "parts")
    near = several.select("leaf", "form", F.explode("parts").alias("part")).join(alike, "part").select("leaf", "form").distinct()
    near = saved(several.drop("parts").dropDuplicates(["leaf", "form"]).join(near, ["leaf", "form"]), "near")

    one = F.col("n") * (1 - similarity) + 1e-9 < FIELDS
    first = F.sequence(F.lit(0), size - 1)
    pairs = F.flatten(F.transform(first, lambda i: F.transform(F.when(one, F.array(i)).otherwise(F.sequence(i, size - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    # a run left open: all the others are the same; two: i < j (i = j opens one, which the pairs with i hold already, but where there is one run)
    hidden = lambda p: F.when(p["i"] == p["j"], F.get("runs", p["i"])).otherwise(F.get("runs", p["i"]).bitwiseXOR(F.get("runs", p["j"])))
    keys = F.transform(F.filter(pairs, lambda p: one | (p["i"] < p["j"]) | (size == 1)), lambda p: F.xxhash64("leaf", p["i"], p["j"], total.bitwiseXOR(hidden(p))))
    node = F.xxhash64("leaf", "form")
    keyed = near.select(node.alias("node"), F.explode(keys).alias("template"))
    several = keyed.groupBy("template").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least <> last").select("template")
    return keyed.join(several, "template")


def _recurring_templates(of: DataFrame, forms: DataFrame, named: DataFrame, min_docs: int) -> DataFrame:
    """template of those in at least min_docs documents."""
    if min_docs > 2:
        owned = of.join(named.select("node", "doc").distinct(), "node").select("template", "doc").distinct()
        return owned.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    met = of.join(forms.select("node", "least", "most"), "node").groupBy("template").agg(F.min("least").alias("a"), F.max("most").alias("b"))
    return met.where(F.lit(min_docs < 2) | (F.col("a") != F.col("b"))).select("template")


def replaced_forms(of: DataFrame, ordered_rounds: int = ORDERED_ROUNDS) -> DataFrame:
    """node, first, last of the forms that go: the least and the greatest first document of the forms that stay and share a template with it.

    of: node, template (recurring), place (doc and line of the form's first line; another one for each form)."""
    spark, number, gone = of.sparkSession, 0, []
    of = saved(of, "undecided")
    while of.head(1):
        rank = F.col("place") if number < ordered_rounds else F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node")
        ranked = of.withColumn("rank", rank)
        tops = ranked.groupBy("template").agg(F.min("rank").alias("top"))
        firsts = ranked.join(tops, "template").groupBy("node").agg(F.min(F.col("rank") == F.col("top")).alias("stays"), F.min("place").alias("place")).where("stays")
        firsts = saved(firsts.select("node", "place"), "staying")
        held = of.join(firsts.select("node"), "node", "left_semi").select("template", F.col("place.doc").alias("doc"))
        held = held.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        left = of.join(firsts, "node", "left_anti")
        goes = saved(left.join(held, "template").groupBy("node").agg(F.min("first").alias("first"), F.max("last").alias("last")), "going")
        rest = saved(left.join(goes, "node", "left_anti"), "undecided")
        discard(of)
        gone.append(goes)
        of, number = rest, number + 1
    every = gone[0] if gone else spark.createDataFrame([], of.select("node", F.col("place.doc").alias("first"), F.col("place.doc").alias("last")).schema)
    for more in gone[1:]:
        every = every.unionByName(more)
    return every


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, ordered_rounds: int = ORDERED_ROUNDS) -> DataFrame:
    """doc_id, text_hash, line_no of the lines to drop."""
    doc, mark = F.struct("doc_id", "text_hash"), F.xxhash64("doc_id", "text_hash")
    lines = saved(parsed_lines(docs, depth, similarity, min_tokens), "parsed")
    # a leaf of one document has no recurring template
    leaves = lines.groupBy("leaf").agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.min("form").alias("f"), F.max("form").alias("g")).where("a <> b")
    leaves = saved(leaves.select("leaf", (F.col("f") != F.col("g")).alias("several")), "leaves")
    met = saved(lines.join(leaves, "leaf"), "lines")
    of = saved(shared_templates(met.where("several"), similarity), "templates")
    named = met.select(F.xxhash64("leaf", "form").alias("node"), doc.alias("doc"), "line_no", mark.alias("mark"))
    # of each form its first line, and marks that tell whether it has several documents
    first = F.min(F.struct("doc", "line_no", "node")).alias("place")
    count = [F.count_distinct("doc").alias("docs")] if min_docs > 2 else []
    forms = saved(named.groupBy("node").agg(first, F.min("mark").alias("least"), F.max("mark").alias("most"), *count), "forms")
    edges = saved(of.join(_recurring_templates(of, forms, named, min_docs), "template").join(forms.select("node", "place"), "node"), "edges")
    goes = saved(replaced_forms(edges, ordered_rounds), "replaced")
    several = F.col("docs") >= min_docs if min_docs > 2 else F.lit(min_docs < 2) | (F.col("least") != F.col("most"))
    forms = forms.withColumn("own", F.col("place.doc")).join(edges.select("node").distinct().withColumn("shares", F.lit(True)), "node", "left").where(several | F.col("shares"))
    # a form that stays is kept in its first document, one that goes where no form that stays is kept in another document
    forms = forms.join(goes, "node", "left").select("node", F.coalesce("first", "own").alias("first"), F.coalesce("last", "own").alias("last"))
    forms = saved(forms, "recurring")  # so that the lines of one very common form are a skewed join's, which Spark splits
    dropped = named.join(forms, "node").where((F.col("doc") != F.col("first")) | (F.col("doc") != F.col("last")))
    return dropped.select("doc.doc_id", "doc.text_hash", "line_no")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with `text` cut to its kept lines, and n_lines, n_dropped (in columns of one struct `line_dedup`)."""
    drops = recurring_lines(docs, **options).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("_timetide_drops"))
    drops = drops.select(F.col("doc_id").alias("_timetide_doc"), F.col("text_hash").alias("_timetide_text"), "_timetide_drops")
    joined = docs.withColumn("_timetide_own_text", text_hash())
    joined = joined.join(drops, (joined["doc_id"] == drops["_timetide_doc"]) & (F.col("_timetide_own_text") == F.col("_timetide_text")), "left")
    lines = F.split(text_or_empty(), "\n")
    none = F.col("_timetide_drops").isNull()
    # array_except looks numbers up by hash: linear in the lines, as a search of the dropped ones for each line is not
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_timetide_drops"), lambda i: F.get(lines, i))
    text = F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n"))
    info = F.struct(F.size(lines).alias("n_lines"), F.coalesce(F.size("_timetide_drops"), F.lit(0)).alias("n_dropped"))
    info = F.when(none, F.struct(F.size(lines).alias("n_lines"), F.lit(0).alias("n_dropped"))).otherwise(info)
    return joined.withColumn("line_dedup", info).withColumn("text", text).drop("_timetide_drops", "_timetide_doc", "_timetide_text", "_timetide_own_text")


def keep_new_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with recurring lines taken out; a document of which no line is left goes, its lines stand in earlier ones.

    n_chars, where docs has it, follows the text."""
    columns = docs.columns
    out = dedup_lines(docs.withColumnRenamed("line_dedup", "_timetide_own") if "line_dedup" in columns else docs, **options)
    out = out.where((F.col("line_dedup.n_dropped") == 0) | (F.trim("text") != ""))
    if "n_chars" in columns:
        cut = F.when(F.col("line_dedup.n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", cut.cast(docs.schema["n_chars"].dataType))
    out = out.drop("line_dedup")
    return (out.withColumnRenamed("_timetide_own", "line_dedup") if "line_dedup" in columns else out).select(*columns)
