"""Pattern detectors as a data table: one pass over the lines, first matching pattern of a cell."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (cell, family, anchor, pattern). Weak patterns count only in files with an anchor of their cell.
PATTERNS = [
    ("server", "flask", True, r"@\w+\.route\("),
    ("server", "express", True, r"\b(?:app|router)\.(?:get|post|put|delete)\("),
    ("client", "fetch", True, r"\bfetch\("),
    ("client", "requests", True, r"\brequests\.(?:get|post|put|delete)\("),
    ("client", "axios", True, r"\baxios\.(?:get|post)\("),
    ("sockets", "listen", True, r"\b(?:listen|bind|accept)\("),
    ("rpc", "grpc", True, r"\bgrpc\b"),
    ("ipc", "pipe", True, r"\b(?:mkfifo|CreateNamedPipe|postMessage)\b"),
    ("training", "loop", True, r"\boptimizer\.step\(|\.backward\("),
    ("training", "epoch", False, r"\bepochs?\b"),
    ("inference", "generate", True, r"\.generate\("),
    ("inference", "sampling", False, r"\b(?:temperature|top_p|top_k)\b"),
    ("models", "module", True, r"class\s+\w+\((?:\w+\.)*Module\)"),
    ("artifacts", "weights", True, r"\b(?:torch\.save|torch\.load|save_pretrained|load_state_dict)\("),
    ("embedding", "vector", True, r"\b(?:cosine_similarity|embed_documents|faiss)\b"),
    ("datasets", "loader", True, r"\b(?:DataLoader|load_dataset)\("),
    ("infrastructure", "docker", True, r"^FROM\s+\S+"),
    ("infrastructure", "terraform", True, r'^resource\s+"'),
    ("kernels", "cuda", True, r"\b__global__\b|<<<[^>]*>>>|\bcudaLaunchKernel\("),
    ("kernels", "triton", True, r"@triton\.(?:jit|autotune)\b"),
    ("kernels", "numba", True, r"@cuda\.jit\b"),
    ("kernels", "device", False, r"\b__device__\b"),
    ("multimodal", "vision", True, r"\b(?:CLIPModel|CLIPProcessor|ViTModel|pixel_values|image_processor)\b"),
    ("multimodal", "audio", True, r"\b(?:WhisperProcessor|Wav2Vec2\w*|input_features|torchaudio)\b"),
    ("multimodal", "media", False, r"\b(?:image|audio|video)_(?:path|url|file)\b"),
    ("post-training", "adapter", True, r"\b(?:LoraConfig|get_peft_model|prepare_model_for_kbit_training)\b"),
    ("post-training", "preference", True, r"\b(?:DPOTrainer|PPOTrainer|RewardTrainer|GRPOTrainer)\b"),
    ("post-training", "concept", False, r"(?i)\b(?:rlhf|reward model|preference data|kl penalty)\b"),
    ("reasoning", "chain", True, r"(?i)\bchain[- ]of[- ]thought\b"),
    ("reasoning", "reflect", False, r"(?i)\bstep by step\b|\breflect on\b"),
    ("llm", "sdk", True, r"\b(?:chat\.completions|messages|responses)\.create\("),
    ("llm", "endpoint", True, r"/v1/(?:chat/completions|messages|completions)\b"),
    ("llm", "model", False, r"\bmodel\s*="),
    ("tools", "definition", True, r"^\s*@(?:\w+\.)?tool\b|\btool_choice\b|\binput_schema\b"),
    ("tools", "dispatch", False, r"\btool_calls?\b"),
    ("chains", "framework", True, r"\b(?:LLMChain|RunnableSequence|StateGraph|AgentExecutor|QueryEngine)\b"),
    ("structured", "schema", True, r"\b(?:response_format|json_schema|with_structured_output)\b"),
    ("structured", "parser", False, r"\b(?:PydanticOutputParser|JsonOutputParser|model_validate_json)\b"),
    ("explain", "library", True, r"\b(?:shap\.\w*Explainer|LimeTextExplainer|IntegratedGradients|captum)\b"),
    ("explain", "hook", False, r"\bregister_(?:forward|backward)_hook\("),
    ("notice", "licence", True, r"(?i)\blicen[sc]ed? under\b"),
    ("notice", "copyright", False, r"(?i)\bcopyright\b"),
    ("credential", "token", True, r"(?i)\btoken\s*="),
    ("credential", "password", False, r"(?i)\bpassword\b"),
]


#: Of each family, texts one of which is in every match of its pattern (in lower case where the pattern ignores case).
LITERALS = {
    "flask": [".route("],
    "express": ["app.", "router."],
    "fetch": ["fetch("],
    "requests": ["requests."],
    "axios": ["axios."],
    "listen": ["listen(", "bind(", "accept("],
    "grpc": ["grpc"],
    "pipe": ["mkfifo", "CreateNamedPipe", "postMessage"],
    "loop": ["optimizer.step(", ".backward("],
    "epoch": ["epoch"],
    "generate": [".generate("],
    "sampling": ["temperature", "top_p", "top_k"],
    "module": ["Module)"],
    "weights": ["torch.save(", "torch.load(", "save_pretrained(", "load_state_dict("],
    "vector": ["cosine_similarity", "embed_documents", "faiss"],
    "loader": ["DataLoader(", "load_dataset("],
    "docker": ["FROM"],
    "terraform": ["resource"],
    "cuda": ["__global__", "<<<", "cudaLaunchKernel("],
    "triton": ["@triton."],
    "numba": ["@cuda.jit"],
    "device": ["__device__"],
    "vision": ["CLIPModel", "CLIPProcessor", "ViTModel", "pixel_values", "image_processor"],
    "audio": ["WhisperProcessor", "Wav2Vec2", "input_features", "torchaudio"],
    "media": ["_path", "_url", "_file"],
    "adapter": ["LoraConfig", "get_peft_model", "prepare_model_for_kbit_training"],
    "preference": ["DPOTrainer", "PPOTrainer", "RewardTrainer", "GRPOTrainer"],
    "concept": ["rlhf", "reward model", "preference data", "kl penalty"],
    "chain": ["of thought", "of-thought"],
    "reflect": ["step by step", "reflect on"],
    "sdk": [".create("],
    "endpoint": ["/v1/"],
    "model": ["model"],
    "definition": ["tool", "input_schema"],
    "dispatch": ["tool_call"],
    "framework": ["LLMChain", "RunnableSequence", "StateGraph", "AgentExecutor", "QueryEngine"],
    "schema": ["response_format", "json_schema", "with_structured_output"],
    "parser": ["PydanticOutputParser", "JsonOutputParser", "model_validate_json"],
    "library": ["shap.", "LimeTextExplainer", "IntegratedGradients", "captum"],
    "hook": ["register_forward_hook(", "register_backward_hook("],
    "licence": ["licen"],
    "copyright": ["copyright"],
    "token": ["token"],
    "password": ["password"],
}


def may_match(text: Column, low: Column, family: str, pattern: str) -> Column:
    """Whether the text holds what every match of the pattern holds; `low` is the text in lower case."""
    column = low if pattern.startswith("(?i)") else text
    return reduce(or_, [F.contains(column, F.lit(x)) for x in LITERALS[family]])


def may_hold_sites(text: Column, low: Column) -> Column:
    """Whether any pattern may match in the text; a text that fails has no site."""
    return reduce(or_, [may_match(text, low, family, pattern) for _, family, _, pattern in PATTERNS])


def detect(lines: DataFrame) -> DataFrame:
    """(path, line_no, cell, family, anchor) of lines of (path, line_no, line). A pattern is tried on lines that hold its literals."""
    lines = lines.withColumn("_low", F.lower("line")).where(may_hold_sites(F.col("line"), F.col("_low")))
    cells = list(dict.fromkeys(p[0] for p in PATTERNS))
    hits = []
    for cell in cells:
        found = F.lit(None).cast("struct<cell:string,family:string,anchor:boolean>")
        for c, family, anchor, pattern in reversed(PATTERNS):
            if c == cell:
                found = F.when(may_match(F.col("line"), F.col("_low"), family, pattern) & F.col("line").rlike(pattern), F.struct(F.lit(c).alias("cell"), F.lit(family).alias("family"), F.lit(anchor).alias("anchor"))).otherwise(found)
        hits.append(found)
    sites = lines.select("path", "line_no", F.explode(F.filter(F.array(*hits), lambda s: s.isNotNull())).alias("s")).select("path", "line_no", "s.*")
    gate = F.bool_or("anchor").over(Window.partitionBy("path", "cell"))
    return sites.withColumn("_gate", gate).where("anchor OR _gate").drop("_gate")
