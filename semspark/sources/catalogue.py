"""Small fixed tables: models, components, presets, templates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.functions import text as X

# The model cards, as published (numbers with a decimal comma).
MODELS = [
    ("Xenova/all-MiniLM-L6-v2", "all-MiniLM-L6-v2", "Sentence Transformers / SBERT", "sentence-transformers/all-MiniLM-L6-v2", "56,26", "41,95", "384", "256 word pieces", "Muy bajo: ONNX quantized aprox. 24,5 MB", "Inglés"),
    ("Xenova/gte-small", "gte-small", "General Text Embeddings", "thenlper/gte-small", "61,36", "49,46", "384", "512 tokens", "Muy bajo: ONNX int8 aprox. 33,8 MB", "Inglés"),
]

# The three components, in order, with their presets (current, target, other).
COMPONENTS = [
    (1, "rol", "role", "speaker identity or perspective"),
    (2, "topico", "topic", "subject or event focus"),
    (3, "accion", "action", "communicative intent or requested operation"),
]
PRESETS = [
    ("role", "local resident affected by flooding", "community member reporting flood damage", "topic = flooded housing; action = report urgent shelter needs"),
    ("topic", "flooded housing", "residential flood damage", "role = local resident affected by flooding; action = report urgent shelter needs"),
    ("action", "report urgent shelter needs", "request emergency housing assistance", "role = local resident affected by flooding; topic = flooded housing"),
]

# The default prompt templates.
INFLUENCE_TEMPLATE = '''SEMANTIC_MOVE_N_PROMPT = """
Generate exactly {num_candidates} candidate replacements for one prompt component.

Component: {component_name}
Definition: {component_definition}

Current: {current_component}
Target: {target_component}

Other components:
{other_components}

Reference text:
{reference_text}

Goal:
Generate alternatives that move the Current component semantically toward the Target component.
Each candidate should be closer in meaning to the Target than the Current component is.

Rules:
- Return only new {component_name} candidates.
- Each candidate must have 2-8 words.
- Each candidate must fit the other components and the reference text.
- Do not copy the Current component exactly.
- Avoid copying the Target component exactly, but semantic closeness is more important than lexical novelty.
- Candidates must be distinct from each other.
- Do not explain.
- Do not use quotes.
- Do not add extra text.

Output format:
Return exactly {num_candidates} lines.
Each line must follow this format:
1) <{component_name}>
2) <{component_name}>
3) <{component_name}>
...
"""'''
TURBULENCE_TEMPLATE = '''TURBULENCE_N_PROMPT_QWEN = """
Generate exactly {num_candidates} very close rewrites of one prompt component.

Component type: {component_name}
Component definition: {component_definition}

Current component value: {current_component}

Context:
{other_components}

Task:
Rewrite Current with minimal wording changes.
Keep the same meaning and same component type.
Keep most words from Current in the same order.
Replace only 1 word if possible, maximum 2 words.
Do not use Context to add new information.

Rules:
- Return only {component_name} candidates.
- Each candidate must have 2-8 words.
- Do not copy Current exactly.
- Do not change the main meaning.
- Do not explain.
- No quotes.
- Exactly {num_candidates} numbered lines.

Format:
1) rewritten {component_name}
2) rewritten {component_name}
3) rewritten {component_name}
...
"""'''
TEMPLATES = {"influence": INFLUENCE_TEMPLATE, "turbulence": TURBULENCE_TEMPLATE}


def model_registry(spark: SparkSession) -> DataFrame:
    """Model cards with their numbers parsed."""
    rows = spark.createDataFrame(MODELS, "model_id string, display_name string, family string, base_model string, average string, retrieval string, dims string, max_input string, approximate_cost string, language string")
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    return rows.select("model_id", "display_name", "family", "base_model", number("average").alias("mteb_average"), number("retrieval").alias("mteb_retrieval"), F.col("dims").cast("int").alias("dimensions"), "max_input", "approximate_cost", "language")


def components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "component_ord int, key string, prompt_name string, definition string")


def presets(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PRESETS, "prompt_name string, current string, target string, other string")
    return components(spark).join(F.broadcast(rows), "prompt_name")


def with_model(requests: DataFrame) -> DataFrame:
    """Requests with their model's card; unknown models are left out (see ``unsupported``)."""
    return requests.join(F.broadcast(model_registry(requests.sparkSession)), "model_id")


def unsupported(requests: DataFrame) -> DataFrame:
    """Requests for a model that the registry lacks."""
    return requests.join(F.broadcast(model_registry(requests.sparkSession).select("model_id")), "model_id", "left_anti")


def with_preset(rows: DataFrame) -> DataFrame:
    """Rows (prompt_name, current, target, other_components) filled from the preset of that name; without one they stay."""
    preset = presets(rows.sparkSession).select("prompt_name", F.col("current").alias("_c"), F.col("target").alias("_t"), F.col("other").alias("_o"))
    out = rows.join(F.broadcast(preset), "prompt_name", "left")
    fill = {"current": "_c", "target": "_t", "other_components": "_o"}
    return out.withColumns({c: F.coalesce(F.col(p), F.col(c)) for c, p in fill.items()}).drop(*fill.values())


def template_select(rows: DataFrame) -> DataFrame:
    """``template`` of each row (operator, custom): the custom text, unless it is missing, blank or one of the defaults."""
    default = F.when(F.col("operator") == "influence", INFLUENCE_TEMPLATE).otherwise(TURBULENCE_TEMPLATE)
    own = X.js_trim(F.col("custom"))
    keep = own.isNotNull() & (own != "") & ~own.isin(*(t.strip() for t in TEMPLATES.values()))
    return rows.withColumn("template", F.when(keep, F.col("custom")).otherwise(default))
