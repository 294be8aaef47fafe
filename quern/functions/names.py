"""Rules on the names of tensors and layers, enum spellings, keyword categories and tokens, as column functions.

Rules are tried in order and the first that fits wins; they test for substrings
of the lower-cased name, so they over-match ("monkey" holds "key"). Null names
take the last, general class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings by class, in order.
FRAGMENT_RULES = (
    ("AttentionQuery", ("q_proj", "to_q", "query")),
    ("AttentionKey", ("k_proj", "to_k", "key")),
    ("AttentionValue", ("v_proj", "to_v", "value")),
    ("AttentionOutput", ("out_proj", "to_out", "o_proj")),
    ("FeedForward", ("mlp", "ff", "feed_forward")),
    ("Normalization", ("norm", "ln", "layer_norm")),
    ("Embedding", ("embed", "wte", "wpe")),
    ("Convolution", ("conv",)),
)
SHARING = {"AttentionQuery": 0.7, "AttentionKey": 0.7, "AttentionValue": 0.5, "AttentionOutput": 0.5, "FeedForward": 0.3, "Normalization": 0.8, "Embedding": 0.1, "Convolution": 0.4, "Generic": 0.2}
_MLP = ("mlp.", "feed_forward", "ffn", ".fc1", ".fc2", "up_proj", "down_proj", "gate_proj", "w1.", "w2.", "w3.")
TENSOR_RULES = (
    ("LayerNorm", ("layernorm", "layer_norm", "ln_", "_ln", "norm.weight")),
    ("Embedding", ("embed_tokens", "wte", "word_embed", "token_embed", "position_embed")),
    ("OutputHead", ("lm_head", "output.weight")),
    ("AttentionQkv", ("qkv", "c_attn")),
    ("AttentionQuery", ("q_proj", ".wq.", "query")),
    ("AttentionKey", ("k_proj", ".wk.", "key")),
    ("AttentionValue", ("v_proj", ".wv.", "value")),
    ("AttentionOutput", ("o_proj", ".wo.", "dense")),
    ("Mlp", _MLP),
)
#: (importance, sensitivity, substrings); names of biases come after the first of them.
IMPORTANCE_RULES = (
    (1.0, "Full", ("layernorm", "layer_norm", "ln_", "_ln", "norm.weight", "rms_norm", "input_layernorm", "final_layernorm", "post_attention_layernorm")),
    (1.0, "Full", (".bias",)),
    (0.95, "Full", ("embed_tokens", "wte", "word_embed", "token_embed", "embed.weight")),
    (0.90, "High", ("lm_head", "output.weight")),
    (0.75, "Medium", ("q_proj", "k_proj", ".wq.", ".wk.", "query", "key")),
    (0.80, "High", ("v_proj", "o_proj", ".wv.", ".wo.", "value", "dense")),
    (0.75, "Medium", ("qkv", "c_attn")),
    (0.50, "Low", _MLP),
)
DEFAULT_IMPORTANCE, DEFAULT_SENSITIVITY = 0.5, "Medium"
PRECISION_NAMES = {"INT4": ("INT4", "I4", "4BIT"), "INT8": ("INT8", "I8", "8BIT"), "BF16": ("BF16", "BFLOAT16"), "FP16": ("FP16", "FLOAT16", "F16", "HALF"), "FP32": ("FP32", "FLOAT32", "F32", "FULL")}
SENSITIVITY_NAMES = {"VeryLow": ("very_low", "verylow"), "Low": ("low",), "Medium": ("medium", "normal"), "High": ("high",), "Full": ("full", "critical")}
DTYPES = ("F32", "F16", "BF16", "I8", "I32", "I64", "BOOL")
PROMPT_KEYWORDS = {
    "Portrait": ("portrait", "face", "person", "woman", "man", "girl", "boy", "character", "headshot", "bust", "selfie"),
    "Landscape": ("landscape", "mountain", "forest", "ocean", "sky", "sunset", "sunrise", "nature", "scenery", "vista", "horizon"),
    "Abstract": ("abstract", "geometric", "pattern", "fractal", "surreal", "dreamlike", "psychedelic", "minimalist"),
    "Photorealistic": ("photo", "photograph", "realistic", "hyperrealistic", "photorealistic", "raw", "unedited", "natural"),
    "Anime": ("anime", "manga", "cartoon", "illustrated", "cel-shaded", "2d", "chibi", "kawaii"),
    "Architecture": ("building", "architecture", "interior", "room", "house", "skyscraper", "cathedral", "bridge", "structure"),
    "Object": ("product", "object", "item", "thing", "device", "tool", "furniture", "vehicle", "food"),
    "Fantasy": ("fantasy", "magical", "dragon", "wizard", "elf", "fairy", "mythical", "enchanted", "sci-fi", "futuristic", "cyberpunk"),
}
#: Word to category and confidence of the semantic analysis.
SEMANTIC_WORDS = {
    **dict.fromkeys(("portrait", "face", "person", "woman", "man", "girl", "boy", "human", "people"), ("Human", 0.9)),
    **dict.fromkeys(("landscape", "mountain", "forest", "ocean", "sky", "sunset", "nature", "scenery"), ("Landscape", 0.8)),
    **dict.fromkeys(("building", "architecture", "city", "street", "house", "castle", "interior"), ("Architecture", 0.8)),
    **dict.fromkeys(("cat", "dog", "animal", "bird", "horse", "wildlife", "pet"), ("Animal", 0.8)),
    **dict.fromkeys(("photorealistic", "realistic", "photography", "photo"), ("Photorealistic", 0.9)),
    **dict.fromkeys(("anime", "manga", "cartoon", "illustration"), ("Anime", 0.9)),
    **dict.fromkeys(("abstract", "artistic", "surreal", "conceptual"), ("Abstract", 0.7)),
    **dict.fromkeys(("fantasy", "sci-fi", "futuristic", "magical", "dragon"), ("Fantasy", 0.8)),
}
STYLE_WORDS = ("anime", "realistic", "photorealistic", "artistic", "cartoon", "3d")
PRECISIONS = {"INT4": (4, 4.0, 0.92), "INT8": (8, 2.5, 0.97), "BF16": (16, 1.8, 0.995), "FP16": (16, 2.0, 0.998), "FP32": (32, 1.0, 1.0)}
#: (preset, start, end, precision).
ZONES = (
    ("Performance", 0.0, 0.4, "INT4"), ("Performance", 0.4, 0.7, "INT8"), ("Performance", 0.7, 1.0, "FP16"),
    ("Balanced", 0.0, 0.25, "INT4"), ("Balanced", 0.25, 0.5, "INT8"), ("Balanced", 0.5, 1.0, "FP16"),
    ("Quality", 0.0, 0.15, "INT8"), ("Quality", 0.15, 1.0, "FP16"),
    ("LowVRAM", 0.0, 0.5, "INT4"), ("LowVRAM", 0.5, 0.85, "INT8"), ("LowVRAM", 0.85, 1.0, "FP16"),
    ("Conservative", 0.0, 0.1, "INT8"), ("Conservative", 0.1, 1.0, "FP16"),
    ("NoiseAdaptive", 0.0, 0.2, "INT4"), ("NoiseAdaptive", 0.2, 0.35, "INT8"), ("NoiseAdaptive", 0.35, 0.6, "INT8"), ("NoiseAdaptive", 0.6, 0.8, "FP16"), ("NoiseAdaptive", 0.8, 1.0, "FP16"),
)
#: Sensitivity to least quality and importance multiplier.
SENSITIVITIES = {"VeryLow": (0.5, 0.3), "Low": (0.7, 0.5), "Medium": (0.85, 0.7), "High": (0.95, 0.9), "Full": (1.0, 1.0)}
#: Sensitivity to the factor of retention.
RETENTION_FACTORS = {"VeryLow": 0.5, "Low": 0.7, "Medium": 1.0, "High": 1.2, "Full": 1.5}
#: Class to (sensitivity, adapts to steps, quality of the first step, of the last).
LAYER_PROFILES = {
    "AttentionQuery": ("Medium", True, 0.5, 0.9),
    "AttentionKey": ("Medium", True, 0.5, 0.9),
    "AttentionValue": ("High", True, 0.7, 0.95),
    "AttentionOutput": ("High", False, 0.9, 0.95),
    "FeedForward": ("Low", True, 0.5, 0.85),
    "Normalization": ("Full", False, 1.0, 1.0),
    "Embedding": ("Full", False, 1.0, 1.0),
    "Convolution": ("Medium", True, 0.6, 0.9),
    "Generic": ("Medium", False, 0.8, 0.9),
}


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text holds one of the parts; false for null."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def first_rule(text: Column, rules, otherwise: str) -> Column:
    """The class of the first rule that fits."""
    lower, out = F.lower(text), F.lit(otherwise)
    for name, parts in reversed(rules):
        out = F.when(has_any(lower, parts), name).otherwise(out)
    return out


def fragment_type(name: Column) -> Column:
    """STR1: the kind of layer by its name."""
    return first_rule(name, FRAGMENT_RULES, "Generic")


def looked_up(key: Column, values: dict, otherwise=None) -> Column:
    """The value of a key in a small literal table; the key is evaluated once."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def sharing_potential(kind: Column) -> Column:
    """STR1: how likely layers of a kind are shared between models."""
    return looked_up(kind, SHARING, 0.2)


def tensor_type(name: Column) -> Column:
    """STR2: the kind of tensor; biases come first."""
    lower = F.lower(name)
    bias = F.coalesce(F.contains(lower, F.lit(".bias")) | F.endswith(lower, F.lit("_bias")), F.lit(False))
    return F.when(bias, "Bias").otherwise(first_rule(name, TENSOR_RULES, "Unknown"))


def recommended_method(kind: Column) -> Column:
    """STR2, T14: None for norms and biases, DCT for all others."""
    return F.when(kind.isin("LayerNorm", "Bias"), "None").otherwise("Dct")


def recommended_retention(kind: Column, base: Column) -> Column:
    """STR2: the share of coefficients to keep, from a base share."""
    return F.when(kind.isin("LayerNorm", "Bias"), 1.0).when(kind == "Embedding", F.least(base * 1.2, F.lit(1.0))).when(kind == "OutputHead", F.least(base * 1.1, F.lit(1.0))).when(kind == "Mlp", F.greatest(base * 0.9, F.lit(0.1))).otherwise(base)


def heuristic_importance(name: Column) -> tuple[Column, Column]:
    """STR3: (importance, sensitivity) by name."""
    lower, value, sense = F.lower(name), F.lit(DEFAULT_IMPORTANCE), F.lit(DEFAULT_SENSITIVITY)
    for v, s, parts in reversed(IMPORTANCE_RULES):
        fits = has_any(lower, parts)
        if parts == (".bias",):
            fits = fits | F.coalesce(F.endswith(lower, F.lit("_bias")), F.lit(False))
        value, sense = F.when(fits, v).otherwise(value), F.when(fits, s).otherwise(sense)
    return value, sense


def tokens(text: Column) -> Column:
    """STR4: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def complexity(words: Column) -> Column:
    """STR4: words / 50, 1 at most."""
    return F.least(F.size(words) / 50.0, F.lit(1.0))


def first_digit(name: Column) -> Column:
    """STR5: the first digit of a name, 0 without one."""
    d = F.regexp_extract(F.coalesce(name, F.lit("")), "[0-9]", 0)
    return F.when(d == "", 0).otherwise(d.cast("int"))


def block_importance(name: Column, face: Column, detail: Column) -> Column:
    """STR5: importance of a block by its name, given the prompt's attention to faces and to detail."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda x: F.contains(n, F.lit(x))
    step = first_digit(n) * 0.1
    return (
        F.when(has("vae") & has("decoder"), 1.0)
        .when(has("attn") & (has("face") | has("portrait")), face)
        .when(has("up_blocks"), (0.5 + F.least(step, F.lit(0.5))) * detail)
        .when(has("down_blocks"), 0.8 - F.least(step, F.lit(0.3)))
        .when(has("mid_block"), 0.7)
        .otherwise(0.5)
    )


def category_ranks(text: Column) -> Column:
    """STR6: a number per category, greatest first: keywords in the text, times the number of categories, plus the more the earlier the category comes."""
    lower, n = F.lower(F.coalesce(text, F.lit(""))), len(PROMPT_KEYWORDS)
    return F.sort_array(F.array(*[sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0)) * n + (n - 1 - i) for i, words in enumerate(PROMPT_KEYWORDS.values())]), asc=False)


def ranked_categories(ranks: Column) -> Column:
    """STR6: the names of the first three ``category_ranks`` that count a keyword; Mixed without any. Ranks are named often here, so give them a column of their own."""
    n, names = len(PROMPT_KEYWORDS), F.array(*map(F.lit, reversed(PROMPT_KEYWORDS)))
    rank = [F.get(ranks, F.lit(k)) for k in range(3)]
    name = [F.get(names, r % n) for r in rank]
    return F.when(rank[2] >= n, F.array(*name)).when(rank[1] >= n, F.array(*name[:2])).when(rank[0] >= n, F.array(name[0])).otherwise(F.array(F.lit("Mixed")))


def precision_of(name: Column) -> Column:
    """STR9: a precision by any of its spellings; null if there is none."""
    return looked_up(F.upper(name), {s: p for p, spellings in PRECISION_NAMES.items() for s in spellings})


def sensitivity_of(name: Column) -> Column:
    """STR9: a sensitivity by any of its spellings, Medium otherwise."""
    return looked_up(F.lower(name), {s: p for p, spellings in SENSITIVITY_NAMES.items() for s in spellings}, "Medium")


def dtype_of(name: Column) -> Column:
    """STR9: a dtype of tensor files, exactly as written there."""
    return F.when(name.isin(*DTYPES), name).otherwise("UNKNOWN")
