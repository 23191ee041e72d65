"""More of the query catalogue: scans, joins with declared membership, gates and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import registry
from .functions import code, text
from .operators import distill, evaluation, filters, joins, split
from .plans import finalize
from .queries import _PAIRED, _SPLIT, _choose, _kind, _log_p, _split, convs, docs, outcomes, protected, query, table
from .sources import adapters, jsonl
from .streaming import resume
from .work import work_folder

# --- scans -----------------------------------------------------------------------------------------------


def _hub(spark, sf):
    """The documents as an upstream's rows, with nested metadata."""
    folder = work_folder(spark, "hub")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), "text", F.struct(F.col("lang").alias("extension"), F.col("source").alias("origin")).alias("metadata"))
    rows.write.parquet(folder)
    return folder




@query("SELECT doc_id AS input_index, source AS origin, length(text) AS chars FROM documents WHERE lang = 'fr'")
def q_hub_scan(spark, sf):
    """Rows of a nested field's value; the scan gets the predicate and reads the named fields alone."""
    mapping = {"input_index": F.col("index"), "origin": F.col("metadata.origin"), "chars": F.char_length("text").cast("long")}
    return jsonl.hub_scan(spark, _hub(spark, sf), F.col("metadata.extension") == "fr", mapping)


@query("SELECT doc_id AS input_index, source AS origin FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25")
def q_hub_bounded(spark, sf):
    """A bounded load: the limit is the feature."""
    mapping = {"input_index": F.col("index"), "origin": F.col("metadata.origin")}
    return jsonl.hub_scan(spark, _hub(spark, sf), F.col("metadata.extension") == "de", mapping, limit=25)


@query("""WITH i AS (SELECT item_id + 2 AS item_id FROM benchmark UNION ALL SELECT item_id FROM benchmark WHERE item_id % 10 = 3), w AS (SELECT item_id FROM benchmark)
SELECT item_id, 'missing' AS side FROM (SELECT item_id FROM w EXCEPT SELECT item_id FROM i) UNION ALL SELECT item_id, 'unexpected' FROM (SELECT item_id FROM i EXCEPT SELECT item_id FROM w)
UNION ALL SELECT item_id, 'repeated' FROM i GROUP BY item_id HAVING count(*) > 1""")
def q_benchmark_checks(spark, sf):
    """A benchmark whose ids are two too high, some of them twice, against contiguous ids from 0."""
    items = table(spark, sf, "benchmark").select("item_id")
    shifted = items.select((F.col("item_id") + 2).alias("item_id")).unionAll(items.where("item_id % 10 = 3"))
    return jsonl.benchmark_violations(shifted, items.count())


@query("""SELECT 'benchmark' AS protected_dataset_id, count(*) AS examples, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark
UNION ALL SELECT source, count(*), CAST(sum(length(text)) AS BIGINT) FROM documents GROUP BY source""")
def q_protected_union(spark, sf):
    """The benchmark and every source's documents as protected examples of registered benchmarks."""
    from .operators import contamination

    held = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", "source")
    examples = {"benchmark": protected(spark, sf), "held": contamination.protected_example(held, "held").join(held.select(F.col("item_id").cast("string").alias("protected_record_id"), "source"), "protected_record_id")}
    examples["held"] = examples["held"].withColumn("protected_dataset_id", F.col("source")).drop("source").select(examples["benchmark"].columns)
    union = jsonl.protected_union(examples, ["benchmark", "held"])
    return union.groupBy("protected_dataset_id").agg(F.count("*").alias("examples"), F.sum(F.char_length("solution")).cast("long").alias("chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS problem_id, quality = 1 AS solved FROM labels")
def q_result_rows(spark, sf):
    """Result rows written as JSON lines and scanned by their unique ids."""
    folder = work_folder(spark, "results")
    table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("problem_id"), (F.col("quality") == 1).alias("solved")).write.json(folder)
    return jsonl.scan_results(spark, folder, "problem_id string, solved boolean")


# --- text and code ---------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'def f(x):' || chr(10) || '    return ''' || event_type || '''' WHEN 1 THEN 'def f(x):' || chr(10) || '    return 1' WHEN 4 THEN 'class f: pass' END AS block FROM events""")
def q_candidate_block(spark, sf):
    """Answers with one block that defines the entry point, one of two, both, none, or no fence at all."""
    own = F.concat(F.lit("def f(x):\n    return '"), "event_type", F.lit("'"))
    fence = lambda c: F.concat(F.lit("So:\n```python\n"), c, F.lit("\n```\n"))
    one, other = fence(F.lit("def f(x):\n    return 1")), fence(F.lit("def g(x):\n    return 2"))
    made = _choose(F.col("event_id") % 5, fence(own), F.concat(other, one), F.concat(one, fence(own)), other, F.lit("class f: pass"))
    return table(spark, sf, "events").select("event_id", code.candidate_block(made, F.lit("f")).alias("block"))


@query("""WITH t AS (SELECT conv_id, turn, role, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
s AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_full, CAST(coalesce(sum(n) FILTER (back > 1), 0) AS BIGINT) AS n_prompt FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 4 <> 3 OR n_prompt = 0 THEN n_full - n_prompt END AS n_trained, CASE WHEN conv_id % 4 <> 3 OR n_prompt = 0 THEN n_prompt END AS first_trained FROM s""")
def q_completion_mask(spark, sf):
    """The bytes of a conversation as tokens, trained on its last turn alone; a fourth has another prompt than its text begins with."""
    rows = convs(spark, sf).select(F.col("input_index").alias("conv_id"), "messages")
    ids = lambda m: F.transform(F.sequence(F.lit(1), F.octet_length(m["content"])), lambda i: i)
    full = F.flatten(F.transform("messages", ids))
    prompt = F.flatten(F.transform(F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0))), ids))
    odd = F.when(F.col("conv_id") % 4 == 3, F.transform(prompt, lambda i: i + 1)).otherwise(prompt)
    mask = rows.select("conv_id", text.completion_mask(full, odd).alias("mask"))
    return mask.select("conv_id", F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_trained"), F.when(F.col("mask").isNotNull(), F.size(F.filter("mask", lambda m: ~m))).cast("long").alias("first_trained"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 5 END AS markers FROM documents")
def q_markup_count(spark, sf):
    rows = _kind(spark, sf, 4)
    made = _choose(F.col("k"), F.col("text"), F.concat(F.lit("<think>"), "lang", F.lit("</think>"), "text"), F.concat("text", F.lit("</think>")), F.concat(F.lit("<think></think><think>"), "text", F.lit("<think></think>")))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")), F.struct(F.lit("assistant").alias("role"), made.alias("content")))
    return rows.select("doc_id", text.markup_count(messages).alias("markers"))


# --- filters and hooks -----------------------------------------------------------------------------------


@query("SELECT doc_id AS input_index FROM documents WHERE lang <> 'en' OR source <> 'src1'")
def q_source_contract(spark, sf):
    """Records that are not of the source they are read as."""
    return filters.source_contract_violations(docs(spark, sf), language="en", source_id="src1", revision="r1", license_name="synthetic").select("input_index")


_COMPRESSED = "WITH d AS (SELECT doc_id, n_chars, n_chars // 2 AS answer, CASE WHEN doc_id % 7 = 0 THEN 'length' ELSE 'stop' END AS f, 1000 + doc_id % 500 AS budget FROM documents)"


@query(_COMPRESSED + " SELECT doc_id, 'target' AS kind FROM d WHERE f = 'stop' AND n_chars > 2048 AND answer > budget UNION ALL SELECT doc_id, 'violation' FROM d WHERE f = 'stop' AND n_chars > 2048 AND answer <= budget")
def q_compression_targets(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(d, F.col("n_chars").alias("full_tokens"), F.expr("n_chars div 2").alias("answer_tokens"), F.when(d % 7 == 0, "length").otherwise("stop").alias("finish_reason"), (1000 + d % 500).alias("budget"))
    kinds = [f(rows).select("doc_id", F.lit(k).alias("kind")) for k, f in (("target", distill.compression_targets), ("violation", distill.compression_violations))]
    return kinds[0].unionByName(kinds[1])


@query("""SELECT doc_id AS input_index, 'python_language' AS validator_id, lang = 'python' AS passed, 'language=' || lang AS detail FROM documents""")
def q_validator_hook(spark, sf):
    """The validator that the registry's language names, loaded by its reference."""
    hook = registry.load(registry.LANGUAGES.get("py").validators[0])
    rows = filters.with_validation(docs(spark, sf), {"python_language": hook})
    return rows.select("input_index", F.explode("validation.results").alias("r")).select("input_index", "r.validator_id", "r.passed", "r.detail")




@query(r"""WITH d AS (SELECT 'documents' AS source, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'documents', doc_id, split_part(text, chr(10), 1) FROM documents UNION ALL SELECT 'conversations', conv_id, text FROM conversations),
n AS (SELECT source, id, CAST(2 + sum(len(regexp_extract_all(t, '\S+'))) AS BIGINT) AS words, CAST(sum(ceil(length(t) / 4)) AS BIGINT) AS quarters FROM d GROUP BY source, id)
SELECT source, 'words' AS counter, count(*) AS records, CAST(sum(words) AS BIGINT) AS tokens, count(*) FILTER (words > 512) AS too_long FROM n GROUP BY source
UNION ALL SELECT source, 'quarters', count(*), CAST(sum(quarters) AS BIGINT), count(*) FILTER (quarters > 512) FROM n GROUP BY source""")
def q_registered_sources(spark, sf):
    """Every registered source measured by every registered token counter."""
    out = None
    for source in sorted(registry.SOURCES.known):
        for counter in sorted(registry.TOKEN_COUNTS.known):
            rows = filters.filter_length(adapters.source_records(spark, source, sf), 0, 512, counter)
            one = rows.agg(F.count("*").alias("records"), F.sum("token_count").cast("long").alias("tokens"), F.count_if(F.col("length_reason") == "too_long").alias("too_long")).select(F.lit(source).alias("source"), F.lit(counter).alias("counter"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id AS item_id, lang || ':' || (7 + doc_id) AS response FROM documents")
def q_generate(spark, sf):
    """The batch inference hook with a backend that answers with the prompt and its seed."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("prompt"))
    return resume.generate(rows, lambda prompts, seeds: [f"{p}:{s}" for p, s in zip(prompts, seeds, strict=True)], seed=7).select("item_id", "response")


# --- joins and splits ------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents")
def q_exact_join(spark, sf):
    """Two tables that must have the same keys, each once."""
    rows = table(spark, sf, "documents")
    return joins.exact_join(rows.select("doc_id", "lang"), rows.select("doc_id", "source"), "doc_id")


@query("""WITH b AS (SELECT doc_id FROM labels WHERE doc_id % 9 <> 4), c AS (SELECT doc_id FROM labels WHERE doc_id % 11 <> 5 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 13 = 1), n AS (SELECT doc_id, count(*) AS k FROM c GROUP BY doc_id)
SELECT coalesce(b.doc_id, n.doc_id) AS task_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM b FULL JOIN n USING (doc_id) WHERE b.doc_id IS NULL OR n.doc_id IS NULL OR n.k > 1""")
def q_paired_problems(spark, sf):
    """Why two runs cannot be paired: tasks that one lacks or has twice."""
    tasks = table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"))
    return evaluation.paired_problems(tasks.where("task_id % 9 <> 4"), tasks.where("task_id % 11 <> 5").unionAll(tasks.where("task_id % 13 = 1")))


@query("SELECT doc_id AS task_id, quality = 1 AS base_passed, toxic = 0 AS candidate_passed FROM labels")
def q_paired_join(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("t"))
    return evaluation.paired_join(rows.select("task_id", F.col("q").alias("passed")), rows.select("task_id", F.col("t").alias("passed")))


@query("""WITH o AS (SELECT o_orderpriority AS suite, CAST(o_orderkey AS VARCHAR) AS task_id, o_orderkey AS k, ('0x' || substr(sha256(concat_ws(chr(0), 'dev', o_orderpriority, CAST(o_orderkey AS VARCHAR))), 1, 16))::UBIGINT % 10 IN (0, 1, 2) AND o_orderpriority <> '1-URGENT' AS dev FROM orders)
SELECT suite, task_id, CASE WHEN k % 101 <> 7 THEN CASE WHEN dev THEN 'qualification' ELSE 'development' END END AS partition, CASE WHEN dev THEN 'development' ELSE 'qualification' END AS expected FROM o WHERE k % 101 = 7 OR k % 53 = 2""")
def q_frozen_membership(spark, sf):
    """A frozen partition some of whose tasks were moved and some lost, against the recomputed one."""
    rule = {"salt": "dev", "modulus": 10, "development": [0, 1, 2], "qualification_only": ["1-URGENT"]}
    key = F.col("o_orderkey")
    tasks = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("suite"), key.cast("string").alias("task_id"), key.alias("k"))
    frozen = split.hash_partition(tasks, **rule).where("k % 101 <> 7")
    moved = F.when(F.col("partition") == "development", "qualification").otherwise("development")
    frozen = frozen.withColumn("partition", F.when(F.col("k") % 53 == 2, moved).otherwise(F.col("partition")))
    return split.frozen_membership_violations(frozen, tasks.drop("k"), **rule)


@query("""SELECT doc_id AS input_index, CASE WHEN doc_id % 5 = 1 THEN 'missing' WHEN doc_id % 5 = 2 THEN 'drift' END AS problem, CASE WHEN doc_id % 5 IN (1, 2) THEN text ELSE lang END AS answer FROM documents""")
def q_reconstruct(spark, sf):
    """Records rebuilt from shard rows, some of which are missing or of another record."""
    source = text.with_fingerprints(docs(spark, sf))
    i = F.col("input_index")
    shards = source.where(i % 5 != 1).select("input_index", F.when(i % 5 == 2, F.reverse("record_sha256")).otherwise(F.col("record_sha256")).alias("input_record_sha256"), "prompt_sha256", F.col("language").alias("final_response"), F.lit("stop").alias("finish_reason"))
    return distill.reconstruct(source, shards).select("input_index", "problem", F.element_at("messages", -1)["content"].alias("answer"))


@query(_SPLIT + """, l AS (SELECT doc_id, quality FROM labels), v AS (SELECT h.record_sha256, bool_or(l.quality = 1) AS yes, bool_or(l.quality = 0) AS no FROM h JOIN l ON l.doc_id = h.input_index GROUP BY h.record_sha256),
judged AS (SELECT parts.part, coalesce(yes, false) AS yes, coalesce(no, false) AS no FROM parts LEFT JOIN v USING (record_sha256))
SELECT part AS partition, count(*) AS before, count(*) FILTER (yes) AS kept, count(*) FILTER (no AND NOT yes) AS refused, count(*) FILTER (NOT yes AND NOT no) AS unverified,
CASE WHEN count(*) FILTER (NOT yes AND NOT no) > 0 THEN 'unverified' WHEN count(*) FILTER (yes AND no) > 0 THEN 'contradictory' WHEN count(*) FILTER (yes) = 0 THEN 'emptied' END AS problem FROM judged GROUP BY part
UNION ALL SELECT NULL, count(*), NULL, NULL, NULL, 'unknown_record' FROM benchmark""")
def q_semantic_accounts(spark, sf):
    """A split filtered by verdicts on some of its records, with verdicts about records it has not."""
    hashes = text.with_fingerprints(docs(spark, sf)).select(F.col("input_index").alias("doc_id"), "record_sha256")
    verdicts = hashes.join(table(spark, sf, "labels"), "doc_id").select("record_sha256", (F.col("quality") == 1).alias("passed"))
    strange = table(spark, sf, "benchmark").select(F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("record_sha256"), F.lit(True).alias("passed"))
    return distill.semantic_accounts(_split(spark, sf), verdicts.unionByName(strange))


@query(_SPLIT + """, l AS (SELECT DISTINCT h.record_sha256 FROM h JOIN labels l ON l.doc_id = h.input_index WHERE l.quality = 1) SELECT input_index, part AS partition FROM parts JOIN l USING (record_sha256)""")
def q_semantic_filter(spark, sf):
    hashes = text.with_fingerprints(docs(spark, sf)).select(F.col("input_index").alias("doc_id"), "record_sha256")
    verdicts = hashes.join(table(spark, sf, "labels"), "doc_id").select("record_sha256", (F.col("quality") == 1).alias("passed"))
    return distill.semantic_filter(_split(spark, sf), verdicts).select("input_index", "partition")


@query("""SELECT 'shortfall' AS problem FROM documents HAVING count(*) FILTER (lang = 'fr') + count(*) FILTER (lang = 'en') < 1000010""")
def q_corpus_problems(spark, sf):
    """A composition that asks for more than there is cannot be frozen."""
    from .plans import corpus

    rows = docs(spark, sf)
    asked = corpus.compose({k: rows.where(F.col("language") == k) for k in ("en", "fr")}, [corpus.Budget("en", 10), corpus.Budget("fr", 1_000_000)], "en", least=1, most=1 << 30)
    return spark.createDataFrame([(p,) for p in finalize.corpus_problems(asked, True)], "problem string")


# --- gates -----------------------------------------------------------------------------------------------


@query(_PAIRED + f""", e AS (SELECT count(*) FILTER (suite IN ('en', 'fr')) AS t, count(*) FILTER (suite IN ('en', 'fr') AND c) AS s, count(*) FILTER (suite IN ('en', 'fr') AND c AND NOT b) AS i, count(*) FILTER (suite IN ('en', 'fr') AND b AND NOT c) AS r,
count(*) FILTER (suite = 'en' AND c) - count(*) FILTER (suite = 'en' AND b) AS en, count(*) FILTER (suite = 'fr' AND c) - count(*) FILTER (suite = 'fr' AND b) AS fr,
count(*) FILTER (suite = 'de' AND c) - count(*) FILTER (suite = 'de' AND b) AS de, count(*) FILTER (suite = 'es' AND c) - count(*) FILTER (suite = 'es' AND b) AS es FROM p), g AS (SELECT *, {_log_p()} AS pv FROM e)
SELECT id AS check_id, ok AS passed FROM g, (VALUES (1, 'primary_membership_exact'), (2, 'primary_minimum_teacher_score'), (3, 'primary_minimum_net_effect'), (4, 'primary_minimum_rate_effect'), (5, 'primary_paired_significance'), (6, 'en_non_regression'),
(7, 'fr_non_regression'), (8, 'de_non_catastrophic'), (9, 'es_non_catastrophic')) v(n, id), LATERAL (SELECT CASE n WHEN 1 THEN t = 100 WHEN 2 THEN s >= 10 WHEN 3 THEN i - r >= 1 WHEN 4 THEN (i - r) / t >= 0.5 WHEN 5 THEN pv <= 0.05 WHEN 6 THEN en >= 0 WHEN 7 THEN fr >= 0 WHEN 8 THEN de >= -1000 ELSE es >= 1 END AS ok)""")
def q_teacher_gate(spark, sf):
    """The nine checks of a teacher over the base, two suites being primary and all four bounded."""
    evidence = evaluation.teacher_evidence(outcomes(spark, sf), ["en", "fr"], ["en", "fr", "de", "es"])
    primary = {"total": 100, "least_passed": 10, "least_net": 1, "least_gain": 0.5, "most_p": 0.05}
    return evaluation.gate(evidence, evaluation.teacher_gates(primary, {"en": 0, "fr": 0}, {"de": 1000, "es": -1}))


@query(_PAIRED + """ SELECT CAST(count(*) FILTER (c) AS BIGINT) AS passed, count(*) AS total, 100 AS required, count(*) FILTER (c) >= 100 AS met FROM p WHERE suite IN ('en', 'fr')""")
def q_target_gate(spark, sf):
    parts = outcomes(spark, sf).where("suite in ('en', 'fr')").groupBy("suite").agg(F.count_if("candidate_passed").alias("passed"), F.count("*").alias("total"))
    return evaluation.target_gate(parts, 100).withColumns({"passed": F.col("passed").cast("long"), "total": F.col("total").cast("long")})


@query(_PAIRED + """, g AS (SELECT CASE WHEN CAST(task_id AS BIGINT) % 3 = 0 THEN 'first' WHEN CAST(task_id AS BIGINT) % 3 = 1 THEN 'second' ELSE 'third' END AS study, suite AS language, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c FROM p GROUP BY 1, 2),
m AS (SELECT study, CASE study WHEN 'second' THEN 0 ELSE b END AS b, CASE WHEN study = 'third' AND language = 'en' THEN 0 ELSE c END AS c FROM g)
SELECT study, CASE WHEN sum(b) = 0 THEN 'inconclusive' WHEN count(*) FILTER (b > 0 AND c = 0) > 0 THEN 'catastrophic' ELSE 'none' END AS conclusion FROM m GROUP BY study""")
def q_cross_language(spark, sf):
    """Three studies over the languages: one as it is, one whose base passes nothing, one that loses all of a language."""
    k = F.col("task_id").cast("long") % 3
    rows = outcomes(spark, sf).withColumn("study", F.when(k == 0, "first").when(k == 1, "second").otherwise("third"))
    counts = rows.groupBy("study", F.col("suite").alias("language")).agg(F.count_if("base_passed").alias("b"), F.count_if("candidate_passed").alias("c"), F.count("*").alias("total"))
    counts = counts.withColumns({"base_passed": F.when(F.col("study") == "second", 0).otherwise(F.col("b")), "candidate_passed": F.when((F.col("study") == "third") & (F.col("language") == "en"), 0).otherwise(F.col("c"))})
    out = None
    for study in ("first", "second", "third"):
        one = evaluation.cross_language_conclusion(counts.where(F.col("study") == study)).select(F.lit(study).alias("study"), "conclusion")
        out = one if out is None else out.unionByName(one)
    return out
