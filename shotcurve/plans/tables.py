"""Evaluation tables derived from the star-schema, events and text tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv

LANGS = ["de", "en", "es", "fr"]
# every listed price once, and one local model without a price
PRICED_MODELS = [*fv.PRICES, "lmstudio/unlisted"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows from events: 5 tasks, 12 models, 5 shots, 3 trials, 2 selections."""
    return results_from_events(table(spark, sf_dir, "events"))


def results_from_events(e: DataFrame) -> DataFrame:
    shot = F.col("event_id") % 5
    return e.select(
        F.lit("run_1").alias("run_id"),
        F.col("event_type").alias("task_id"),
        F.concat(F.lit("cat_"), F.substring("event_type", 1, 1)).alias("category"),
        F.concat(F.lit("vendor/model_"), (F.col("user_id") % 12).cast("string")).alias("model_name"),
        F.when(shot == 0, 0).when(shot == 1, 1).when(shot == 2, 2).when(shot == 3, 4)
        .otherwise(8).alias("shot_count"),
        (F.floor(F.col("event_id") / 5) % 3 + 1).cast("int").alias("trial_id"),
        F.when(F.floor(F.col("event_id") / 15) % 2 == 0, "fixed").otherwise("tfidf")
        .alias("example_selection"),
        F.col("props").alias("input"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.col("user_id").alias("input_tokens"),
        (F.col("event_id") % 97).alias("output_tokens"))


def lineitem_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows from lineitem: task = flag and status, model = supplier mod 12,
    shot by line number, score = ten discounts."""
    li = table(spark, sf_dir, "lineitem")
    shot = F.col("l_linenumber") % 5
    return li.select(
        F.lit("run_li").alias("run_id"),
        F.concat("l_returnflag", "l_linestatus").alias("task_id"),
        F.col("l_returnflag").alias("category"),
        F.concat(F.lit("vendor/model_"), (F.col("l_suppkey") % 12).cast("string")).alias("model_name"),
        F.when(shot == 0, 0).when(shot == 1, 1).when(shot == 2, 2).when(shot == 3, 4)
        .otherwise(8).alias("shot_count"),
        (F.col("l_orderkey") % 3 + 1).cast("int").alias("trial_id"),
        F.when(F.col("l_partkey") % 2 == 0, "fixed").otherwise("tfidf").alias("example_selection"),
        F.least(F.lit(1.0), F.col("l_discount") * 10).alias("score"),
        F.floor("l_extendedprice").cast("bigint").alias("latency_ms"),
        F.floor("l_quantity").cast("bigint").alias("input_tokens"),
        (F.col("l_orderkey") % 97).alias("output_tokens"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant turn after it as expected and actual text."""
    c = table(spark, sf_dir, "conversations")
    user = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("expected_output"))
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual_output"))
    method = F.col("conv_id") % 3
    return user.join(reply, ["conv_id", "turn"]).withColumn(
        "scoring_method",
        F.when(method == 0, "exact_match").when(method == 1, "contains").otherwise("f1"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short expected/actual texts, some of them equal, contained, in mixed
    scripts or inside markdown."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    return p.select(
        "p_partkey",
        F.when(kind == 0, F.col("p_type"))
        .when(kind == 1, F.concat(F.col("p_type"), F.lit(":"), size))
        .when(kind == 2, F.concat(F.lit("分類は"), F.col("p_type"), F.lit("デス")))
        .when(kind == 3, F.concat(F.lit("category: "), F.col("p_name")))
        .when(kind == 4, F.concat(F.lit("- "), F.col("p_name"), F.lit("\n2. "), F.col("p_brand")))
        .otherwise(F.lit("")).alias("expected_output"),
        F.when(kind == 0, F.lower("p_type"))
        .when(kind == 1, F.concat(F.col("p_type"), F.lit("-"), (F.col("p_size") % 7).cast("string"),
                                  F.lit(" "), F.col("p_brand")))
        .when(kind == 2, F.concat(F.col("p_type"), F.lit("の分類"), size))
        .when(kind == 3, F.concat(F.lit("The  category is: "), F.upper("p_name"), F.lit("!")))
        .when(kind == 4, F.concat(F.lit("```text\n"), F.col("p_name"), F.lit("\n``` `"),
                                  F.col("p_brand"), F.lit("`")))
        .otherwise(F.col("p_name")).alias("actual_output"))


def judge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """llm_judge cases from part: keyword, sentence and rubric expectations,
    with and without input and variations, and a grader reply for some."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    rubric = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit('", "size": '),
                      F.col("p_size").cast("string"), F.lit("}"))
    return p.select(
        "p_partkey",
        F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat("p_name", F.lit(".")))
        .otherwise(rubric).alias("expected_output"),
        (kind == 2).alias("expected_is_rubric"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("actual_output"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("input"),
        F.when(F.col("p_size") % 3 == 0, F.array("p_type", "p_brand")).alias("acceptable_variations"),
        F.lit("llm_judge").alias("scoring_method"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(
            F.lit('{"score": 0.'), (F.col("p_size") % 10).cast("string"), F.lit(', "reason": "r"}')))
        .when(F.col("p_partkey") % 4 == 1, F.lit("cannot evaluate"))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Score: 0."), (F.col("p_size") % 10).cast("string")))
        .alias("grader_reply"))


def grader_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grader replies of six forms, one of them unreadable."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 6
    digit = (F.col("event_id") % 10).cast("string")
    value = F.least(F.col("value").cast("decimal(10,2)"), F.lit(1.5).cast("decimal(10,2)"))
    return e.select(
        "event_id",
        F.when(kind == 0, F.concat(F.lit('{"score": '), value.cast("string"), F.lit(', "reason": "r"}')))
        .when(kind == 1, F.concat(F.lit("Score: 0."), digit))
        .when(kind == 2, F.lit(".5"))
        .when(kind == 3, F.concat(F.lit('note {"score": 0.'), digit, F.lit("}")))
        .when(kind == 4, F.lit("cannot evaluate"))
        .otherwise(F.concat(F.lit("```json\n{\"score\": \"0."), digit, F.lit("\"}\n```")))
        .alias("reply"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs with and without think blocks, for all four providers."""
    e = table(spark, sf_dir, "events")
    kind, who = F.col("event_id") % 4, F.col("user_id") % 4
    return e.select(
        "event_id",
        F.when(who == 0, "lmstudio/m").when(who == 1, "gpt-5.4").when(who == 2, "claude-x")
        .otherwise("gemini-y").alias("model_name"),
        F.when(kind == 0, F.concat(F.lit("<think>a b</think> "), F.col("event_type")))
        .when(kind == 1, F.lit(" <think>only</think>"))
        .when(kind == 2, F.concat(F.col("event_type"), F.lit("\n"))).alias("output"))


def example_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples: one task per language, every seventh document a
    distractor."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("task_id"), F.col("doc_id").alias("pos"),
        F.col("text").alias("input"), F.col("source").alias("output"),
        (F.col("doc_id") % 7 == 0).alias("is_distractor"))


def benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as test cases of the language tasks."""
    lang = F.col("item_id") % 4
    task = F.when(lang == 0, LANGS[0]).when(lang == 1, LANGS[1]).when(lang == 2, LANGS[2]).otherwise(LANGS[3])
    return table(spark, sf_dir, "benchmark").select(
        task.alias("task_id"), lang.cast("int").alias("task_pos"),
        F.concat(F.lit("cat_"), task).alias("category"), F.col("item_id").alias("pos"),
        F.col("text").alias("input"), F.col("text").alias("expected_output"),
        F.lit("contains").alias("scoring_method"))


def turn_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as test cases; the task is the conversation modulo 5."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        F.concat(F.lit("task_"), (F.col("conv_id") % 5).cast("string")).alias("task_id"),
        (F.col("conv_id") % 5).cast("int").alias("task_pos"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("pos"),
        F.col("text").alias("input"))


def pack_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task pack per part as JSON text: one task, two examples, perhaps a
    distractor, a text case and a rubric case."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")

    def pair(a, b):
        return F.struct(F.col(a).alias("input"), F.col(b).alias("output"))

    def case(text, expected, method, variations):
        return F.struct(F.col(text).alias("input"), expected.alias("expected_output"),
                        F.lit(method).alias("scoring_method"), variations.alias("acceptable_variations"))

    rubric = F.parse_json(F.to_json(F.struct(F.col("p_brand").alias("brand"), size.alias("size"))))
    none = F.lit(None).cast("array<string>")
    task = F.struct(
        F.concat(F.lit("task_"), key).alias("task_id"),
        F.col("p_brand").alias("category"),
        F.col("p_name").alias("description"),
        F.when(size % 3 == 0, "easy").otherwise("hard").alias("difficulty"),
        F.array(pair("p_name", "p_type"), pair("p_brand", "p_type")).alias("examples"),
        F.array(case("p_name", F.col("p_type").cast("variant"), "exact_match", none),
                case("p_brand", rubric, "llm_judge", F.array("p_type"))).alias("test_cases"),
        F.when(size % 4 == 0, F.array(F.lit("Acquisition"), F.lit("Fidelity")))
        .when(size % 4 == 1, F.array().cast("array<string>")).alias("measures"),
        F.when(size % 2 == 0, F.concat(F.lit("do "), F.col("p_name"))).alias("instruction"),
        F.when(size % 2 == 0, F.array(pair("p_type", "p_name"))).alias("distractors"))
    pack = F.struct(
        F.concat(F.lit("pack_"), key).alias("pack_id"), F.col("p_name").alias("pack_name"),
        F.col("p_type").alias("description"), F.lit("1.0").alias("version"),
        F.array("p_brand").alias("categories"), F.array(task).alias("tasks"))
    return p.select(
        "p_partkey", "p_size", F.to_json(pack).alias("json"), F.to_json(task).alias("task_json"),
        F.concat(F.lit("/packs/task_pack_"), key, F.lit(".json")).alias("file_path"))
