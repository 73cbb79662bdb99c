"""Fixed values.

Word lists, lookup tables, price lists, file-name suffixes and patterns whose
exact content decides results.  They are stated here in one place and in their
natural order; everything else in the package refers to them by name.
"""

from __future__ import annotations

# --- query types -----------------------------------------------------------
QUERY_TYPES = ("ocr", "counting", "spatial", "chart", "fine_grained", "stem", "general")

TEXT_FIELDS = ("question", "prompt", "query", "text", "instruction", "problem", "input")

# Dataset-name rules are tried before text rules; the first rule that holds wins.
DATASET_RULES = (
    ("chart", ("chart", "plotqa", "dvqa", "figureqa", "tabmwp")),
    ("ocr", ("ocr", "textvqa", "docvqa", "st-vqa", "stvqa", "infographic", "receipt")),
    ("counting", ("count", "tallyqa", "howmany")),
    ("spatial", ("spatial", "relation", "vcr", "gqa", "nlvr")),
    ("fine_grained", ("fgvc", "fine", "birds", "cub", "cars", "aircraft", "food", "logo")),
    ("stem", ("science", "math", "ai2d", "mathvista", "geometry", "chemistry", "physics")),
)

TEXT_RULES = (
    ("chart", ("chart", "graph", "plot", "bar chart", "line chart", "pie chart", "axis",
               "legend", "trend", "table", "x-axis", "y-axis")),
    ("ocr", ("ocr", "read the text", "text in the image", "what does the sign say", "document",
             "receipt", "license plate", "handwritten", "transcribe")),
    ("counting", ("how many", "count", "number of", "total number", "many objects", "how much",
                  "quantity")),
    ("spatial", ("left", "right", "above", "below", "under", "over", "behind", "in front",
                 "between", "next to", "beside", "relative position", "where is", "closer",
                 "farther")),
    ("fine_grained", ("fine-grained", "fine grained", "species", "breed", "brand", "logo",
                      "model of", "specific type", "exact type", "identify the", "subtle")),
    ("stem", ("solve", "calculate", "equation", "formula", "math", "geometry", "physics",
              "chemistry", "biology", "science", "which of the following")),
)

# --- text statistics --------------------------------------------------------
SPATIAL_TERMS = ("left", "right", "above", "below", "behind", "front", "between")
CHART_TERMS = ("chart", "graph", "axis", "legend", "table", "plot")
COUNTING_TERMS = ("how many", "count", "number of", "total")
OCR_TERMS = ("text", "read", "sign", "document", "ocr", "word")

# --- evidence features ------------------------------------------------------
EVIDENCE_COLUMNS = (
    "generic_blur_dist", "generic_crop_dist", "lowres_dist", "query_cond_mean", "query_cond_max",
    "query_cond_std", "random_perturb_mean", "ocr_like_dist", "chart_like_dist",
    "counting_like_dist", "spatial_like_dist",
)

# What each distance adds up: a constant, and a weight per quantity of the sample.
EVIDENCE_TERMS = {
    "generic_blur_dist": (0.08, {"spread": 0.18, "length_score": 0.05, "jitter": 1.0}),
    "generic_crop_dist": (0.10, {"mean_abs": 0.12, "off_half": 0.04, "jitter": 1.0}),
    "lowres_dist": (0.12, {"diff": 0.15, "digit_ratio": 0.05, "jitter": 1.0}),
    "random_perturb_mean": (0.07, {"random": 0.10, "gap": 0.05}),
    "ocr_like_dist": (0.10, {"ocr_terms": 0.20, "alpha_ratio": 0.12, "gap": 0.05}),
    "chart_like_dist": (0.10, {"chart_terms": 0.22, "digit_ratio": 0.10, "gap": 0.04}),
    "counting_like_dist": (0.10, {"counting_terms": 0.22, "digit_ratio": 0.08, "spread": 0.05}),
    "spatial_like_dist": (0.10, {"spatial_terms": 0.22, "gap": 0.08, "mean_abs": 0.04}),
}

# Which three distances describe a sample of each query type; "" is the default.
QUERY_CONDITIONED = {
    "ocr": ("lowres_dist", "ocr_like_dist", "generic_blur_dist"),
    "chart": ("lowres_dist", "chart_like_dist", "generic_crop_dist"),
    "counting": ("counting_like_dist", "generic_crop_dist", "generic_blur_dist"),
    "spatial": ("spatial_like_dist", "generic_crop_dist", "random_perturb_mean"),
    "": ("generic_blur_dist", "generic_crop_dist", "random_perturb_mean"),
}

# --- column candidates, first existing one wins -----------------------------
ID_CANDIDATES = ("sample_id", "id", "index")
CORRECT_CANDIDATES = ("is_correct", "score", "hit")
PROMPT_CANDIDATES = ("question", "prompt", "Question", "Prompt", "text", "query")
IMAGE_CANDIDATES = ("image", "image_path", "Image", "image_paths", "img_path", "asset", "assets")
PREDICTION_CANDIDATES = ("prediction", "answer", "response", "output")
PREDICTION_ID_CANDIDATES = ("id", "index")
ASSET_FIELDS = ("image_path", "img_path", "image", "Image", "asset", "uri")
IMAGE_ASSET_TYPES = ("image", "image_tsv", "image_url")

# --- result files -----------------------------------------------------------
RESULT_SUFFIXES = ("_openai_result", "_result", "_gpt-4o-mini", "_gpt-4o-mini_score",
                   "_gpt-4o-mini_extract", "_auxmatch", "_results")
RESULT_EXTENSIONS = ("xlsx", "pkl", "csv", "json", "jsonl", "parquet", "tsv")
RUN_STAMP_DIRS = ("T20251025_G", "T20251027_Gb55f788e")
DERIVED_RESULT_FRAGMENTS = ("_acc", "_score", "_extract")
DERIVED_PREDICTION_FRAGMENTS = ("_results", "_extract", "_score", "_acc")
# Read order of result files; the order decides which duplicate wins.
RESULT_KIND_ORDER = ("Math", "MCQ", "Y/N", "VQA", "OCRBench")

# --- datasets ---------------------------------------------------------------
DATASET_TASKS = {
    "MMMU_DEV_VAL": "vqa_mc",
    "MathVista_MINI": "math",
    "MathVision_MINI": "math",
    "MathVerse_MINI": "math",
    "MMBench_DEV_EN_V11": "vqa_mc",
    "RealWorldQA": "vqa_oe",
    "MMStar": "vqa_mc",
    "HallusionBench": "vqa_mc",
    "TextVQA_VAL": "vqa_oe",
    "ChartQA_TEST": "ocr_qa",
    "DocVQA_VAL": "ocr_qa",
    "InfoVQA_VAL": "ocr_qa",
    "AI2D_TEST": "vqa_mc",
    "OCRBench": "ocr_qa",
}

DATASET_ALIASES = {
    "MMMU_DEV_VAL": ("MMMU_DEV_VAL", "mmmu_dev_val", "MMMU-DEV-VAL", "MMMU_DEV"),
    "MathVista_MINI": ("MathVista_MINI", "mathvista_mini", "MathVista-MINI"),
    "MathVision_MINI": ("MathVision_MINI", "mathvision_mini", "MathVision-MINI"),
    "MathVerse_MINI": ("MathVerse_MINI", "mathverse_mini", "MathVerse-MINI"),
    "MMBench_DEV_EN_V11": ("MMBench_DEV_EN_V11", "mmbench_dev_en_v11", "MMBench-DEV-EN-V11"),
    "RealWorldQA": ("RealWorldQA", "realworldqa", "RealWorld-QA"),
    "MMStar": ("MMStar", "mmstar", "MM-Star"),
    "HallusionBench": ("HallusionBench", "hallusionbench", "Hallusion-Bench"),
    "TextVQA_VAL": ("TextVQA_VAL", "textvqa_val", "TextVQA-VAL"),
    "ChartQA_TEST": ("ChartQA_TEST", "chartqa_test", "ChartQA-TEST"),
    "DocVQA_VAL": ("DocVQA_VAL", "docvqa_val", "DocVQA-VAL"),
    "InfoVQA_VAL": ("InfoVQA_VAL", "infovqa_val", "InfoVQA-VAL"),
    "AI2D_TEST": ("AI2D_TEST", "ai2d_test", "AI2D-TEST"),
    "OCRBench": ("OCRBench", "ocrbench", "OCR-Bench"),
}

# Datasets whose asset tables are keyed by a column other than `index`.
ASSET_KEY_COLUMNS = {"HallusionBench": "index", "MMMU_DEV_VAL": "id"}

# Split ratios (train, dev, test) and the split priority of a doubly listed id.
SPLIT_RATIOS = {"train": 0.7, "dev": 0.1, "test": 0.2}
SPLIT_PRIORITY = ("train", "dev", "test")

# --- tokens and prices ------------------------------------------------------
WORDS_TO_TOKENS = 1.33
SIMPLE_WORDS_TO_TOKENS = 1.3
TOKENS_PER_IMAGE = 256
DEFAULT_TOKEN_ESTIMATE = 100

OUTPUT_TOKEN_ESTIMATES = {
    "vqa_mc": 10,
    "classification": 10,
    "vqa_oe": 50,
    "ocr_qa": 50,
    "doc_qa": 150,
    "math_logic": 150,
    "math": 150,
    "unknown": 100,
}
DEFAULT_OUTPUT_TOKENS = 100

# Image-token rules by model family.
DEFAULT_IMAGE_TOKENS = {"clip": 256, "llava": 576, "qwen": 256, "generic": 256}
PATCH_SIZE = 14
LLAVA_TARGET, LLAVA_GRID = 336, 24
QWEN_TIERS = ((224 * 224, 256), (448 * 448, 512), (None, 1024))
GENERIC_IMAGE_TOKEN_RANGE = (256, 1024)

# Price list used when no pricing configuration is given: (input, output) per 1M tokens.
DEFAULT_PRICES = {
    "InternVL2_5-78B": (5.0, 15.0),
    "Qwen2.5-VL-72B-Instruct": (4.0, 12.0),
    "Qwen2.5-VL-32B-Instruct": (2.0, 6.0),
    "MiMo-VL-7B-RL": (0.5, 1.5),
    "Phi-3.5-Vision": (0.3, 1.0),
    "SmolVLM2": (0.2, 0.6),
    "llava_next_vicuna_7b": (0.3, 1.0),
    "Gemma3-27B": (0.8, 2.4),
    "Janus-Pro-1B": (0.1, 0.3),
    "Janus-Pro-7B": (0.3, 0.9),
    "Kimi-VL-A3B-Thinking-2506": (0.15, 0.45),
    "Pixtral-12B": (0.4, 1.2),
    "Qianfan-VL-8B": (0.3, 0.9),
    "deepseek_vl2": (0.4, 1.2),
    "deepseek_vl2_tiny": (0.1, 0.3),
}
FALLBACK_INPUT_PRICE, FALLBACK_OUTPUT_PRICE = 1.0, 3.0

# Model pool used when no configuration is given.
DEFAULT_MODELS = (
    "InternVL2_5-78B", "MiMo-VL-7B-RL", "Phi-3.5-Vision", "Qwen2.5-VL-32B-Instruct",
    "Qwen2.5-VL-72B-Instruct", "SmolVLM2", "llava_next_vicuna_7b", "Gemma3-27B", "Janus-Pro-1B",
    "Janus-Pro-7B", "Kimi-VL-A3B-Thinking-2506", "Pixtral-12B", "Qianfan-VL-8B", "deepseek_vl2",
    "deepseek_vl2_tiny", "GPT4o", "GeminiFlash2-5",
)

# --- encoders: (name, modality, dimension, max_length, image_size, patch_size)
ENCODERS = (
    ("intfloat/e5-small-v2", "text", 384, 512, None, None),
    ("intfloat/e5-base-v2", "text", 768, 512, None, None),
    ("intfloat/e5-large-v2", "text", 1024, 512, None, None),
    ("BAAI/bge-m3", "text", 1024, 8192, None, None),
    ("thenlper/gte-large", "text", 1024, 8192, None, None),
    ("facebook/dinov2-small", "vision", 384, None, 224, 14),
    ("facebook/dinov2-base", "vision", 768, None, 224, 14),
    ("facebook/dinov2-large", "vision", 1024, None, 224, 14),
    ("openai/clip-vit-large-patch14", "vision", 768, None, 224, 14),
    ("google/siglip-large-patch16-384", "vision", 1024, None, 384, 16),
)

FUSION_METHODS = ("concat", "average", "weighted_average", "normalize_concat", "only_text",
                  "only_image")

ABLATIONS = (
    "full", "no_query_type", "no_model_profile", "no_calibration", "no_cost",
    "no_extra_features", "no_ranking", "no_route_ce", "sample_difficulty_only",
    "random_extra_features",
)

# --- character classes (whitespace and digits as Unicode text handling defines them)
WHITESPACE_CLASS = (r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WORD_PATTERN = f"[^{WHITESPACE_CLASS}]+"
ALPHA_CLASS = r"\p{L}"
DIGIT_CLASS = (r"\p{Nd}\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
               r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
               r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
               r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}")

# --- report grades of the rank score
RANK_GRADES = ((0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair"), (None, "Poor"))

TOKEN_PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
