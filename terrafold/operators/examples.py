"""Training examples: templates, validation, sampling, splits, packaging.

Random choices are md5-based on the row key, so a run gives the same rows at
any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from .ordered import first_rows, hash_order, with_hash_rank, with_running_sum
from .selection import exact_percentiles


def hash_choice(key: Column, salt: str, n: int) -> Column:
    """Stable pseudo-random number 0 … n-1 of a row key."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n))


def _choose(options: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by the column of that name; ``{is:x}`` becomes Yes/No by the label."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _label_values(label: Column) -> dict[str, Column]:
    yes_no = {f"is:{c}": F.when(label == c, "Yes").otherwise("No") for c in ("urban", "water", "forest", "agriculture")}
    linear = F.when(label == "urban", fv.SAR_LINEAR_ANSWERS["urban"]).otherwise(fv.SAR_LINEAR_ANSWERS["other"])
    return {"label": label, **yes_no, "linear": linear}


def _scene_values() -> dict[str, Column]:
    return {
        "label": F.coalesce("object", F.lit("land cover")),
        "sensor": F.col("sensor"),
        "modality": F.col("modality"),
    }


def _image_id() -> Column:
    return F.concat(F.col("scene_id"), F.lit(".tif"))


def _questions(templates: list[tuple[str, str]]) -> Column:
    return F.posexplode(
        F.array(*[F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer")) for q, a in templates])
    )


def make_captions(scenes: DataFrame) -> DataFrame:
    template = _choose(fv.SCENE_CAPTIONS, hash_choice(F.col("scene_id"), "caption", len(fv.SCENE_CAPTIONS)))
    return scenes.select(_image_id().alias("image_id"), fill(template, _scene_values()).alias("caption"))


def make_vqa(scenes: DataFrame) -> DataFrame:
    rows = scenes.select("scene_id", "object", "sensor", "modality", _questions(fv.SCENE_QUESTIONS).alias("n", "qa"))
    values = _scene_values()
    return rows.select(
        _image_id().alias("image_id"),
        fill(F.col("qa.question"), values).alias("question"),
        fill(F.col("qa.answer"), values).alias("answer"),
    )


def _boxed(box: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in box])


def make_referring(scenes: DataFrame) -> DataFrame:
    template = _choose(fv.SCENE_REFERRING, hash_choice(F.col("scene_id"), "referring", len(fv.SCENE_REFERRING)))
    values = {"label": F.coalesce("object", F.lit("area"))}
    return scenes.select(
        _image_id().alias("image_id"),
        fill(template, values).alias("expression"),
        _boxed(fv.SCENE_REFERRING_BOX).alias("bbox"),
    )


def _labelled(
    rows: DataFrame, key: str, label: str, captions: list[str], questions: list[tuple[str, str]], referring: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    values = _label_values(F.col(label))

    def one(options, salt):
        return fill(_choose(options, hash_choice(F.col(key), salt, len(options))), values)

    image = F.col(key).alias("image_id")
    cap = rows.select(image, one(captions, "caption").alias("caption"))
    qa = rows.select(key, label, _questions(questions).alias("n", "qa")).select(
        image, F.col("qa.question").alias("question"), fill(F.col("qa.answer"), values).alias("answer")
    )
    ref = rows.select(image, one(referring, "referring").alias("expression"), _boxed(fv.LABEL_REFERRING_BOX).alias("bbox"))
    return cap, qa, ref


def make_label_examples(rows: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captions, questions and boxes of labelled images."""
    return _labelled(rows, key, label, fv.LABEL_CAPTIONS, fv.LABEL_QUESTIONS, fv.LABEL_REFERRING)


def make_sar_examples(rows: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captions, questions and boxes of radar scenes."""
    return _labelled(rows, key, label, fv.SAR_CAPTIONS, fv.SAR_QUESTIONS, fv.SAR_REFERRING)


def make_fusion_examples(pairs: DataFrame, label: str) -> DataFrame:
    """Fusion captions of matched radar and optical scenes (``sar_id``, ``optical_id``)."""
    template = _choose(fv.FUSION_CAPTIONS, hash_choice(F.col("sar_id"), "fusion", len(fv.FUSION_CAPTIONS)))
    return pairs.select(
        F.concat(F.lit("pc_sar_"), "sar_id", F.lit(".tif")).alias("sar_image_id"),
        F.concat(F.lit("pc_opt_"), "optical_id", F.lit(".tif")).alias("optical_image_id"),
        F.col("sar_id").alias("scene_id"),
        fill(template, {"label": F.col(label)}).alias("caption"),
    )


def union_supervision(captions: DataFrame, vqa: DataFrame, referring: DataFrame) -> DataFrame:
    """One table of the three kinds of example, tagged with task and modality."""
    tagged = [
        df.withColumn("task_type", F.lit(task))
        for df, task in ((captions, "caption"), (vqa, "vqa"), (referring, "grounding"))
    ]
    both = tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)
    known = F.col("modality") if "modality" in both.columns else F.lit(None).cast("string")
    return both.withColumn("modality", F.coalesce(known, tx.detect_modality(F.col("image_id"))))


def prompt_select(rows: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Add ``prompt`` by (modality, task); unknown modalities use optical, unknown tasks the question prompt.

    ``rows``: ``task_type, modality`` and, where the task needs them,
    ``question`` and ``expression``. A template table is ``modality, task, template``.
    """
    def optional(name):
        return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")

    modality = F.when(F.col("modality").isin("sar", "fusion"), F.col("modality")).otherwise("optical")
    task = F.when(F.col("task_type") == "fusion", "caption").otherwise(F.col("task_type"))
    modality = F.when(F.col("task_type") == "fusion", "fusion").otherwise(modality)
    if templates is None:
        pairs = [(f"{m}|{t}", fv.PROMPT_TEXTS[key]) for m, t, key in fv.PROMPT_TABLE]
        table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
        template = F.coalesce(
            F.try_element_at(table, F.concat_ws("|", modality, task)), F.lit(fv.PROMPT_TEXTS["optical_vqa"])
        )
        out = rows.withColumn("__t", template)
    else:
        lookup = templates.select(
            F.col("modality").alias("__m"), F.col("task").alias("__k"), F.col("template").alias("__t")
        )
        out = rows.join(lookup, (modality == F.col("__m")) & (task == F.col("__k")), "left").drop("__m", "__k")
        out = out.withColumn("__t", F.coalesce("__t", F.lit(fv.PROMPT_TEXTS["optical_vqa"])))
    values = {"question": optional("question"), "expression": optional("expression")}
    return out.withColumn("prompt", fill(F.col("__t"), values)).drop("__t")


# ---- validation ------------------------------------------------------------

STRUCTURED_QUERY = (
    "query_text string, task_type string, location string, start_date string, end_date string, sensor string, "
    "object string, event string, change_flag string, question string, referring_expression string, "
    "confidence string, used_fallback string, image_id string"
)


def schema_reason(query: Column) -> Column:
    """First schema violation of a parsed structured query, null when it is valid."""
    boolean = ["true", "false"]

    def flag(name):
        value = query[name]
        return value.isNotNull() & ~F.lower(value).isin(*boolean)

    def dated(name):
        return query[name].isNotNull() & F.try_to_timestamp(query[name]).isNull()

    return (
        F.when(query["query_text"].isNull(), "query_text missing")
        .when(query["task_type"].isNotNull() & ~query["task_type"].isin(*fv.TASK_TYPES), "task_type")
        .when(query["sensor"].isNotNull() & ~query["sensor"].isin(*fv.SENSORS), "sensor")
        .when(dated("start_date"), "start_date")
        .when(dated("end_date"), "end_date")
        .when(flag("change_flag"), "change_flag")
        .when(flag("used_fallback"), "used_fallback")
        .when(query["confidence"].isNotNull() & query["confidence"].try_cast("double").isNull(), "confidence")
    )


def schema_check(rows: DataFrame, json: str) -> DataFrame:
    """Parse a JSON column as a structured query; ``reject_reason`` is null for a valid row."""
    parsed = rows.withColumn("__q", F.from_json(F.col(json), STRUCTURED_QUERY))
    # text that is no JSON object parses to a struct of nulls
    is_object = F.col(json).isNotNull() & F.json_object_keys(_json_or_null(F.col(json))).isNotNull()
    return parsed.withColumn(
        "reject_reason", F.when(~is_object, "json_parse").otherwise(schema_reason(F.col("__q")))
    ).drop("__q")


def _json_or_null(json: Column) -> Column:
    """The text when it is well-formed JSON, else null."""
    return F.when(F.try_parse_json(json).isNotNull(), json)


def validate_pairs(
    rows: DataFrame,
    text: str = "query_text",
    json: str = "structured_query",
    gold: str = "seed_query",
    max_chars: int = 300,
    adversarial: str | None = None,
) -> DataFrame:
    """First failing check of every generated pair: ``json_parse``, ``schema``, ``label_drift``, ``query_sanity``."""
    checked = schema_check(rows, json).withColumnRenamed("reject_reason", "__schema")
    drift = ~F.coalesce(F.try_parse_json(F.col(json)) .cast("string") == F.try_parse_json(F.col(gold)).cast("string"), F.lit(False))
    if adversarial is not None:
        drift = drift & ~F.coalesce(F.col(adversarial), F.lit(False))
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    unfit = (body == "") | (F.length(text) > max_chars) | body.rlike(r"\{.*\}")
    reason = (
        F.when(F.col("__schema") == "json_parse", "json_parse")
        .when(F.col("__schema").isNotNull(), "schema")
        .when(drift, "label_drift")
        .when(unfit, "query_sanity")
    )
    return checked.withColumn("reject_reason", reason).drop("__schema")


def merge_training_rows(rows: DataFrame, file: str) -> DataFrame:
    """Rows of several training files, tagged with the task their file's name tells and the modality their image's name tells."""
    known = F.col("modality") if "modality" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({"task_type": tx.task_of_file(F.col(file)), "modality": F.coalesce(known, tx.detect_modality(F.col("image_id")))})


# ---- samples and splits ----------------------------------------------------


def sample_limit(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """Pseudo-random ``n`` rows, the same ones on every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def first_per_task(df: DataFrame, task: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every task; each input partition is cut to them before the shuffle."""
    return first_rows(df, [task], order, n, "__r").drop("__r")


def stratified_sample(
    df: DataFrame, stratum: str, key: str, rate: float = 0.1, whole: list[str] | None = None, seed: str = "0"
) -> DataFrame:
    """⌈rate · n⌉ rows of every stratum in hash order; the strata in ``whole`` are kept complete."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    quota = F.ceil(F.col("__n") * rate - 1e-9)
    if whole:
        quota = F.when(F.col(stratum).isin(*whole), F.col("__n")).otherwise(quota)
    ranked = with_hash_rank(df, [stratum], key, seed, "__r")
    limits = sizes.select(F.col(stratum).alias("__st"), quota.alias("__quota"))
    joined = ranked.join(limits, F.col(stratum).eqNullSafe(F.col("__st")))
    return joined.filter(F.col("__r") <= F.col("__quota")).drop("__r", "__quota", "__st")


def holdout_by_aoi(scenes: DataFrame, aoi: str, held_out: dict[str, list[str]]) -> DataFrame:
    """``split``: whole AOIs go to test, per sensor; everything else trains."""
    test = F.lit(False)
    for sensor, areas in held_out.items():
        test = test | ((F.col("sensor") == sensor) & F.col(aoi).isin(*areas))
    return scenes.withColumn("split", F.when(test, "test").otherwise("train"))


def assign_split_family(
    df: DataFrame, family: str, held_out: int, train_share: float, val_share: float, seed: str = "0"
) -> DataFrame:
    """Whole families in one split. The first ``held_out`` families in hash order are test; the others fill
    train, then validation, then test towards the wanted shares."""
    families = df.groupBy(family).agg(F.count("*").alias("__n")).filter(F.col(family).isNotNull())
    hashed = families.withColumn("__h", hash_order(F.col(family), seed))
    chunk = F.substring("__h", 1, 3)
    ranked = with_running_sum(hashed, [], chunk, ["__h", family], F.lit(1), "__r")
    open_rows = F.when(F.col("__r") > held_out, F.col("__n")).otherwise(0)
    filled = with_running_sum(ranked, [], chunk, ["__h", family], open_rows, "__upto")
    total = filled.agg(F.sum(open_rows)).scalar()
    before = F.col("__upto") - F.col("__n")
    split = (
        F.when(F.col("__r") <= held_out, "test")
        .when(before < total * train_share, "train")
        .when(before < total * (train_share + val_share), "val")
        .otherwise("test")
    )
    return df.join(filled.select(family, split.alias("split")), family, "left")


def time_ordered_split(df: DataFrame, time: str, train: float = 0.9, val: float = 0.1) -> DataFrame:
    """Earliest share trains, the next validates, the rest tests.

    The cut-offs are exact time quantiles and rows of the same moment stay
    together, so no later row is ever trained on and no global sort is needed.
    """
    micros = df.select(F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("__t"))
    probs = sorted({train, min(1.0, round(train + val, 9))})
    cuts = exact_percentiles(micros, [], "__t", probs)
    table = cuts.agg(F.array_sort(F.collect_list(F.struct("prob", "percentile")))).scalar()
    at = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    with_cuts = df.withColumn("__c", table)
    train_cut = F.get("__c", F.lit(0))["percentile"]
    val_cut = F.get("__c", F.lit(len(probs) - 1))["percentile"]
    split = F.when(at <= train_cut, "train").when((at <= val_cut) & F.lit(val > 0), "val").otherwise("test")
    return with_cuts.withColumn("split", split).drop("__c")


def hash_split(df: DataFrame, key: str, train: float = 0.9, val: float = 0.1, seed: str = "0") -> DataFrame:
    """Independent random split by key hash; needs no shuffle."""
    point = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn(
        "split", F.when(point < train, "train").when(point < train + val, "val").otherwise("test")
    )


# ---- chat packaging --------------------------------------------------------


def sorted_json(json: Column) -> Column:
    """Minified JSON text with keys in alphabetical order, for an object of known fields."""
    parsed = F.from_json(json, "map<string,string>")
    pairs = F.array_sort(F.map_entries(parsed))
    return F.to_json(F.map_from_entries(pairs))


def package_messages(rows: DataFrame, system_prompt: str, user: str, assistant: str) -> DataFrame:
    """Add ``messages``: system, user and assistant turn."""
    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return rows.withColumn(
        "messages",
        F.array(
            turn("system", F.lit(system_prompt)), turn("user", F.col(user)), turn("assistant", F.col(assistant))
        ),
    )


def package_check(rows: DataFrame, family: str = "family", split: str = "split") -> DataFrame:
    """One row of checks over packaged rows: one system prompt, parsable and unfenced answers, families in one split."""
    def content(i):
        return F.get("messages", F.lit(i))["content"]

    system, answer = content(0), content(2)
    flat = rows.select(
        F.sha2(system, 256).alias("sys"),
        F.try_parse_json(answer).isNotNull().alias("parses"),
        F.contains(answer, F.lit("```")).alias("fenced"),
    )
    base = flat.agg(
        F.count("*").alias("n"),
        (F.min("sys") == F.max("sys")).alias("one_system_prompt"),
        F.bool_and("parses").alias("answers_parse"),
        (~F.bool_or("fenced")).alias("no_fences"),
    )
    crossing = (
        rows.groupBy(family)
        .agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
        .agg(F.count_if(F.col("lo") != F.col("hi")).alias("c"))
    )
    return base.withColumn("crossing_families", crossing.scalar())
