"""Benchmark files as samples: one row for each question, in the common schema.

Readers take paths that Spark can open. Records that lack what a question needs are dropped, as their benchmarks
say; nothing else is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.numbers import parse_number, strip, to_float
from assaylake.functions.text import program_operands
from assaylake.schemas import SAMPLES

_TABLE = "array<struct<table_id:string,caption:string,rows:array<array<string>>,header_rows:int,metadata:map<string,string>>>"


def _tables(name: Column | str, rows: Column) -> Column:
    one = F.struct(F.lit(name).alias("table_id") if isinstance(name, str) else name.alias("table_id"), F.lit(None).cast("string").alias("caption"), rows.alias("rows"), F.lit(1).alias("header_rows"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return F.when(F.size(rows) > 0, F.array(one)).otherwise(F.array().cast(_TABLE))


def sample(benchmark: str, split: str, key: Column, family: Column, tags: Column, question: Column, text: Column, tables: Column, gold: Column, metadata: Column, extra: tuple[Column, ...] = ()) -> tuple[Column, ...]:
    """The columns of a sample of a benchmark."""
    return (
        F.lit(benchmark).alias("benchmark"), F.lit(split).alias("split"), F.concat(F.lit(f"{benchmark}:{split}:"), key).alias("sample_id"), family.alias("task_family"),
        tags.alias("capability_tags"), F.lit("en").alias("language"), question.alias("question"), F.coalesce(text, F.array().cast("array<string>")).alias("context_text"),
        tables.alias("context_tables"), gold.alias("gold"), metadata.alias("metadata"), *extra,
    )


def gold_answer(answer: Column, number: Column, kind: Column | str, program: Column | None = None, acceptable: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(answer.alias("answer"), (F.lit(kind) if isinstance(kind, str) else kind).alias("answer_type"), number.cast("double").alias("numeric_value"), (none if program is None else program).alias("program"), (F.array(answer) if acceptable is None else acceptable).alias("acceptable_answers"))


def _tags(*names: str) -> Column:
    return F.array(*(F.lit(n) for n in names))


def finqa(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A JSON array of reports with one question each; the gold is a number where the executed answer is one."""
    raw = spark.read.schema("id string, filename string, pre_text array<string>, post_text array<string>, table array<array<string>>, qa struct<question:string,answer:string,program:string,exe_ans:string>").option("multiLine", True).json(path)
    number = F.when(~F.lower("qa.exe_ans").isin("yes", "no"), F.col("qa.exe_ans").try_cast("double"))
    gold = gold_answer(F.coalesce("qa.exe_ans", "qa.answer"), number, F.when(number.isNotNull(), "numeric").otherwise("boolean"), F.col("qa.program"), F.array("qa.answer"))
    return raw.where("id is not null").select(*sample("finqa", split, F.col("id"), F.lit("finqa_program"), _tags("calculation", "table_text", "evidence_grounding"), F.col("qa.question"), F.concat("pre_text", "post_text"), _tables("table", F.col("table")), gold, F.create_map(F.lit("filename"), F.col("filename"))))


def tatqa(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A JSON array of passages with several questions each; paragraphs in their order, answers joined by bars."""
    raw = spark.read.schema("table struct<uid:string,table:array<array<string>>>, paragraphs array<struct<uid:string,order:int,text:string>>, questions array<struct<uid:string,order:int,question:string,answer:string,derivation:string,answer_type:string,answer_from:string,scale:string>>").option("multiLine", True).json(path)
    q = raw.select(F.array_sort(F.transform("paragraphs", lambda p: F.struct(p["order"].alias("order"), p["text"].alias("text")))).alias("paragraphs"), F.col("table.table").alias("rows"), F.coalesce("table.uid", F.lit("table")).alias("table_id"), F.inline("questions"))
    listed = F.from_json("answer", "array<string>")
    answers = F.when(F.startswith("answer", F.lit("[")), listed).otherwise(F.array("answer"))
    q = q.withColumn("answers", answers).where((strip(F.coalesce("uid", F.lit(""))) != "") & (strip(F.coalesce("question", F.lit(""))) != "") & F.col("answer").isNotNull() & (F.col("answer") != "") & (F.size("answers") > 0))
    kind = F.coalesce("answer_type", F.lit("span"))
    counted = kind.isin("arithmetic", "count")
    number = F.when(counted & (F.size("answers") == 1), to_float(strip(F.regexp_replace(F.get("answers", F.lit(0)), "[,$]", ""))))
    tags = F.when(counted, _tags("table_text", "calculation")).otherwise(_tags("table_text", "evidence_grounding"))
    metadata = F.create_map(F.lit("scale"), F.coalesce("scale", F.lit("")), F.lit("answer_type"), kind, F.lit("answer_from"), F.coalesce("answer_from", F.lit("")), F.lit("derivation"), F.coalesce("derivation", F.lit("")))
    text = F.filter(F.transform("paragraphs", lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    return q.select(*sample("tatqa", split, F.col("uid"), F.concat(F.lit("tatqa_"), F.replace(kind, F.lit("-"), F.lit("_"))), tags, strip(F.col("question")), text, _tables(F.col("table_id"), F.coalesce("rows", F.array().cast("array<array<string>>"))), gold_answer(F.array_join("answers", " | "), number, kind, acceptable=F.col("answers")), metadata))


def reused_turns(program: Column, prior: Column) -> Column:
    """The earlier turns whose answer a program uses: an operand, no step reference or constant, within 1e-4 of its size."""
    operands = program_operands(program)
    numbered = F.transform(prior, lambda a, i: F.struct(to_float(a).alias("a"), i.alias("i")))
    used = F.filter(numbered, lambda p: p["a"].isNotNull() & F.exists(operands, lambda x: F.abs(x - p["a"]) <= 1e-4 * F.greatest(F.abs(p["a"]), F.lit(1.0))))
    return F.transform(used, lambda p: p["i"])


def convfinqa(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A JSON array of conversations, one sample for each turn with the turns before it; conversations whose questions and
    answers differ in number, or without an id, are dropped."""
    raw = spark.read.schema("id string, pre_text array<string>, post_text array<string>, table array<array<string>>, annotation struct<dialogue_break:array<string>,turn_program:array<string>,exe_ans_list:array<string>>").option("multiLine", True).json(path)
    n = F.size("annotation.dialogue_break")
    whole = raw.where(F.col("id").isNotNull() & (F.col("id") != "") & (n > 0) & (n == F.size("annotation.exe_ans_list")))
    turns = whole.select("*", F.posexplode("annotation.dialogue_break").alias("turn", "question"))
    at = F.col("turn")
    program, answer = F.get("annotation.turn_program", at), F.get("annotation.exe_ans_list", at)
    prior = F.slice("annotation.exe_ans_list", F.lit(1), at)
    history = F.zip_with(F.slice("annotation.dialogue_break", F.lit(1), at), prior, lambda q, a: F.struct(F.lit("user").alias("role"), q.alias("content"), a.alias("turn_answer")))
    number = F.when(~F.lower(answer).isin("yes", "no"), to_float(answer))
    used = reused_turns(F.coalesce(program, F.lit("")), prior)
    text = lambda x: x.cast("string")
    metadata = F.create_map(
        F.lit("conversation_id"), F.col("id"), F.lit("turn_index"), text(at), F.lit("n_turns"), text(n), F.lit("is_first_turn"), text(at == 0), F.lit("is_last_turn"), text(at == n - 1),
        F.lit("reuses_turns"), F.array_join(F.transform(used, lambda i: i.cast("string")), ","),
    )
    gold = gold_answer(answer, number, F.when(number.isNotNull(), "numeric").otherwise("boolean"), program)
    return turns.select(*sample("convfinqa", split, F.concat("id", F.lit(":"), text(at)), F.lit("convfinqa_turn"), _tags("conversation", "calculation", "table_text"), F.col("question"), F.concat("pre_text", "post_text"), _tables("table", F.col("table")), gold, metadata, (history.alias("history"),)))


def finance_reasoning(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A JSON array of questions whose context is a table by columns, written as JSON; it becomes a grid with the row labels
    in the order in which they first appear. Other contexts are text. Rows without a numeric or boolean gold are dropped."""
    raw = spark.read.schema("question_id string, level string, question string, context string, ground_truth string, difficulty string").option("multiLine", True).json(path)
    columns = F.from_json("context", "map<string,map<string,string>>")
    labels = F.array_distinct(F.flatten(F.transform(F.map_values("grid"), lambda m: F.map_keys(m))))
    parsed = raw.withColumn("grid", F.when(F.startswith(strip(F.coalesce("context", F.lit(""))), F.lit("{")), columns)).withColumn("labels", labels)
    header = F.concat(F.array(F.lit("")), F.map_keys("grid"))
    body = F.transform("labels", lambda label: F.concat(F.array(label), F.transform(F.map_values("grid"), lambda m: F.coalesce(F.try_element_at(m, label), F.lit("")))))
    is_grid = F.col("grid").isNotNull() & (F.size("labels") > 0)
    rows = F.when(is_grid, F.concat(F.array(header), body)).otherwise(F.array().cast("array<array<string>>"))
    truth = F.lower("ground_truth").isin("true", "false")
    number = F.when(~truth, to_float(F.col("ground_truth")))
    good = parsed.where(F.col("question_id").isNotNull() & (strip(F.coalesce("question", F.lit(""))) != "") & (truth | number.isNotNull()))
    text = F.when(is_grid | F.col("context").isNull() | (F.col("context") == ""), F.array().cast("array<string>")).otherwise(F.array("context"))
    metadata = F.create_map(F.lit("level"), F.coalesce("level", F.lit("")), F.lit("ground_truth"), F.col("ground_truth"), F.lit("difficulty"), F.coalesce("difficulty", F.lit("")))
    return good.select(*sample("finance_reasoning", split, F.col("question_id"), F.concat(F.lit("finance_reasoning_"), F.coalesce("level", F.lit("all"))), _tags("calculation", "formula"), F.col("question"), text, _tables("table", rows), gold_answer(F.col("ground_truth"), number, F.when(truth, "boolean").otherwise("numeric")), metadata))


def answer_shape(answer: Column) -> Column:
    """boolean for an answer that starts with yes or no, numeric for a short one that is a number, else analytical."""
    plain = strip(answer)
    return F.when(plain.rlike(r"(?i)^(yes|no)\b"), "boolean").when((F.length(plain) < 40) & parse_number(plain).isNotNull(), "numeric").otherwise("analytical")


def filings_qa(spark: SparkSession, path: str, split: str, id_field: str = "id") -> DataFrame:
    """JSON lines of questions about filings, with evidence by document and page; ``id_field`` names the record's id."""
    raw = spark.read.schema(f"`{id_field}` string, company string, doc_name string, question_type string, question_reasoning string, question string, answer string, justification string, evidence array<struct<evidence_text:string,doc_name:string,evidence_page_num:string>>").json(path)
    shape = answer_shape(F.col("answer"))
    number = F.when(shape == "numeric", parse_number(F.col("answer"))["value"])
    evidence = F.transform("evidence", lambda e: F.struct(F.coalesce(e["doc_name"], F.col("doc_name")).alias("document_id"), e["evidence_page_num"].try_cast("int").alias("page"), e["evidence_text"].alias("text_snippet")))
    metadata = F.create_map(F.lit("answer_shape"), shape, F.lit("company"), F.coalesce("company", F.lit("")), F.lit("doc_name"), F.coalesce("doc_name", F.lit("")), F.lit("question_type"), F.coalesce("question_type", F.lit("")))
    text = F.filter(F.transform("evidence", lambda e: e["evidence_text"]), lambda t: t.isNotNull())
    return raw.where(F.col(id_field).isNotNull()).select(*sample("filings_qa", split, F.col(id_field), F.concat(F.lit("filings_qa_"), F.coalesce("question_type", F.lit("open"))), _tags("evidence_grounding", "retrieval"), F.col("question"), text, F.array().cast(_TABLE), gold_answer(F.col("answer"), number, shape), metadata, (evidence.alias("evidence"),)))


def verified(spark: SparkSession, paths: dict[str, str], checksums: dict[str, str] | None = None, counts: dict[str, int] | None = None) -> None:
    """Raise where a file has another SHA-256 or another number of records than it should have."""
    for name, path in sorted(paths.items()):
        if checksums is not None:
            found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
            if found != checksums.get(name):
                raise ValueError(f"{name}: the file has SHA-256 {found}, not {checksums.get(name)}")
        if counts is not None:
            n = spark.read.text(path).where(F.trim("value") != "").count()
            if n != counts.get(name):
                raise ValueError(f"{name}: {n} records, not {counts.get(name)}")


def secque(spark: SparkSession, paths: dict[str, str], split: str, checksums: dict[str, str] | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """JSON lines by category, in turn from the sorted categories; the company and the period stand in the context's first line.

    :param checksums: SHA-256 of each category's file. :param counts: records of each; what differs raises.
    """
    from assaylake.operators.samples import round_robin

    verified(spark, paths, checksums, counts)

    parts = [spark.read.schema("QID string, question_type string, Question string, ground_truth_answer string, context_markdown_with_headers string, accession_number string").json(p).withColumn("category", F.lit(c)) for c, p in sorted(paths.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    head = F.substring_index("context_markdown_with_headers", "\n", 1)
    company = strip(F.regexp_extract(head, r"(?i)^#*\s*(.+?)(?:\s+(?:10-[KQ]|annual|quarterly|for|fiscal)\b|\s*[-–|,]|$)", 1))
    year = F.regexp_extract(head, r"\b((?:19|20)\d{2})\b", 1)
    metadata = F.create_map(F.lit("category"), F.col("category"), F.lit("company"), company, F.lit("fiscal_year"), year)
    placed = round_robin(every, None, stratum="category", order="QID")
    return placed.select(*sample("secque", split, F.col("QID"), F.concat(F.lit("secque_"), F.col("category")), _tags("analysis", "evidence_grounding", "table_text"), F.col("Question"), F.array("context_markdown_with_headers"), F.array().cast(_TABLE), gold_answer(F.col("ground_truth_answer"), F.lit(None), "analytical"), metadata, (F.col("turn").alias("turn"),)))


def jsonl_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples in the full schema from JSON lines; a line that is no such record fails the read."""
    return spark.read.schema(SAMPLES).option("mode", "FAILFAST").json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts as a corpus with plain blanks."""
    from assaylake.operators.retrieval import normalise_page

    raw = spark.read.schema("document_id string, page int, text string").json(path)
    return raw.select("document_id", "page", F.concat("document_id", F.lit("#p"), F.col("page").cast("string")).alias("chunk_id"), normalise_page(F.coalesce("text", F.lit(""))).alias("text"))


def pages_from_files(spark: SparkSession, path: str, read: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """The pages of document files as a corpus with plain blanks; a file that cannot be read has no pages, a page that cannot be
    read is empty.

    :param read: the texts of a file's pages; without it PDF files are read, which needs ``pypdf``.
    """
    from assaylake.operators.retrieval import normalise_page

    if read is None:
        read = _pdf_pages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts = read(bytes(content))
                except Exception:  # noqa: BLE001  whatever a broken file makes a reader raise
                    texts = []
                yield pd.DataFrame([(name, i + 1, t or "") for i, t in enumerate(texts)], columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(run, "path string, page int, text string")
    document = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return found.select(document.alias("document_id"), "page", F.concat(document, F.lit("#p"), F.col("page").cast("string")).alias("chunk_id"), normalise_page(F.col("text")).alias("text"))


def _pdf_pages(content: bytes) -> list[str | None]:
    import io

    import pypdf

    texts: list[str | None] = []
    for page in pypdf.PdfReader(io.BytesIO(content)).pages:
        try:
            texts.append(page.extract_text())
        except Exception:  # noqa: BLE001
            texts.append(None)
    return texts


#: Readers by name, and the splits that each benchmark has.
READERS = {"finqa": finqa, "tatqa": tatqa, "convfinqa": convfinqa, "finance_reasoning": finance_reasoning, "filings_qa": filings_qa, "secque": secque}
SPLITS = {"finqa": ("train", "dev", "test"), "tatqa": ("train", "dev", "test"), "convfinqa": ("train", "dev"), "finance_reasoning": ("easy", "medium", "hard"), "filings_qa": ("open",), "secque": ("test",)}


def available_splits(benchmark: str) -> tuple[str, ...]:
    if benchmark not in SPLITS:
        raise ValueError(f"unknown benchmark {benchmark!r}: one of {sorted(SPLITS)}")
    return SPLITS[benchmark]


def manifests(spark: SparkSession) -> DataFrame:
    """The registered benchmarks with their splits and task types."""
    return spark.createDataFrame([(name, list(splits), (READERS[name].__doc__ or "").split(".")[0]) for name, splits in sorted(SPLITS.items())], "benchmark string, splits array<string>, about string")


def read_samples(spark: SparkSession, benchmark: str, source, split: str) -> DataFrame:
    """The samples of a registered benchmark; an unknown benchmark or split raises."""
    if split not in available_splits(benchmark):
        raise ValueError(f"{benchmark} has no split {split!r}: one of {SPLITS[benchmark]}")
    return READERS[benchmark](spark, source, split)
