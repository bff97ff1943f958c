"""Each family of the detectors on a line of its own, and the gate of weak ones."""

import re

import pytest

from stratalens.operators.detectors import LITERALS, PATTERNS, detect, may_hold_sites

SITES = [
    ("kernels", "cuda", "__global__ void add(float *x) {"), ("kernels", "triton", "@triton.jit"), ("kernels", "numba", "@cuda.jit"), ("multimodal", "vision", "model = CLIPModel.load()"),
    ("multimodal", "audio", "p = WhisperProcessor()"), ("post-training", "adapter", "cfg = LoraConfig(r=8)"), ("post-training", "preference", "DPOTrainer(model)"), ("reasoning", "chain", "Use chain-of-thought"),
    ("llm", "sdk", "client.chat.completions.create(x)"), ("llm", "endpoint", 'post("/v1/chat/completions")'), ("tools", "definition", "@tool"), ("chains", "framework", "g = StateGraph(S)"),
    ("structured", "schema", "response_format={}"), ("explain", "library", "shap.TreeExplainer(m)"),
]


@pytest.mark.parametrize("cell, family, line", SITES)
def test_family(spark, cell, family, line):
    got = detect(spark.createDataFrame([("a", 1, line)], "path string, line_no int, line string")).collect()
    assert (cell, family, True) in {(r.cell, r.family, r.anchor) for r in got}


def test_weak_hits_need_an_anchor_in_their_file(spark):
    rows = [("a", 1, "reward model"), ("b", 1, "reward model"), ("b", 2, "PPOTrainer(m)"), ("c", 1, "step by step"), ("d", 1, "tool_call"), ("d", 2, "tool_choice")]
    got = {(r.path, r.line_no) for r in detect(spark.createDataFrame(rows, "path string, line_no int, line string")).collect()}
    assert got == {("b", 1), ("b", 2), ("d", 1), ("d", 2)}


#: Matches of every alternative of the patterns that have several, in odd case where the case is ignored.
MATCHES = """@x.route(|app.get(|router.delete(|fetch(|requests.put(|axios.post(|x listen(|bind(|accept(|grpc|mkfifo|CreateNamedPipe|postMessage|optimizer.step(|loss.backward(|epoch|epochs|m.generate(|temperature|top_p|top_k
class A(Module)|class A(nn.Module)|torch.save(|torch.load(|x save_pretrained(|x load_state_dict(|cosine_similarity|embed_documents|faiss|DataLoader(|load_dataset(|FROM x|resource "|__global__|k<<<1, 2>>>|cudaLaunchKernel(|@triton.autotune
@cuda.jit|__device__|CLIPModel|CLIPProcessor|ViTModel|pixel_values|image_processor|Wav2Vec2Model|Wav2Vec2|input_features|torchaudio|WhisperProcessor|image_path|audio_url|video_file|LoraConfig|get_peft_model|prepare_model_for_kbit_training
DPOTrainer|PPOTrainer|RewardTrainer|GRPOTrainer|RLHF|Reward Model|PREFERENCE data|KL penalty|Chain of Thought|CHAIN-OF-THOUGHT|chain of-thought|chain-of thought|Step By Step|Reflect on|chat.completions.create(|messages.create(|responses.create(
/v1/messages|/v1/completions|/v1/chat/completions|model =|@a.tool|@tool|tool_choice|input_schema|tool_call|tool_calls|LLMChain|RunnableSequence|StateGraph|AgentExecutor|QueryEngine|response_format|json_schema|with_structured_output
PydanticOutputParser|JsonOutputParser|model_validate_json|shap.Explainer|LimeTextExplainer|IntegratedGradients|captum|register_forward_hook(|register_backward_hook(|LICENSED under|licence under|License Under|Copyright|TOKEN =|PassWord""".replace("\n", "|").split("|")


def test_literals_pass_every_match(spark):
    from pyspark.sql import functions as F

    lines = [x for x in MATCHES] + ["plain prose from here", ""]
    assert set(LITERALS) == {p[1] for p in PATTERNS} and all(any(re.search(p[3], x) for x in lines) for p in PATTERNS)
    df = spark.createDataFrame([(str(i), i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    may = {r.line_no for r in df.where(may_hold_sites(F.col("line"), F.lower("line"))).collect()}
    assert may == {i for i, x in enumerate(lines) if any(re.search(p[3], x) for p in PATTERNS)}
    first = {}
    for i, x in enumerate(lines):
        for cell, family, anchor, pattern in PATTERNS:
            if re.search(pattern, x):
                first.setdefault((i, cell), (family, anchor))
    want = {(i, cell, family) for (i, cell), (family, anchor) in first.items() if anchor}
    assert {(r.line_no, r.cell, r.family) for r in detect(df).collect()} == want
