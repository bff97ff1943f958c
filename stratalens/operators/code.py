"""Source-code operators: symbols, masking, structure hashes, calls and imports.

Text-shaped steps are column expressions. Finding where a definition ends needs a scan with state, which is
done a file at a time in Arrow batches; nothing else leaves the JVM.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import containing

# Definition headers by extension; group 1 is the name.
HEADERS = {
    "js": [
        r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)",
        r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)",
        r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>)[^{]*\{",
        r"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::\s*[\w<>\[\], |]+)?\s*\{",
    ],
    "c": [
        r"^(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+([A-Za-z_]\w*)[^;()]*\{",
        r"^[A-Za-z_][\w\s\*&<>,:]*?\b(?:[A-Za-z_]\w*::)?(~?[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{",
        r"^\s+(?:(?:virtual|static|inline|explicit|constexpr)\s+)*[A-Za-z_][\w\*&<>:]*\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:override\s*)?\{",
        r"^\s*#\s*define\s+([A-Za-z_]\w*)\(",
    ],
    "m": [r"^[-+]\s*\([^)]*\)\s*([A-Za-z_]\w*)", r"^@(?:interface|implementation|protocol)\s+([A-Za-z_]\w*)"],
    "java": [
        r"^\s*(?:public|private|protected|static|final|abstract|\s)*\s*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
        r"^\s*(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\s*\{",
        r"^\s+(?:public|private|protected)\s+([A-Z]\w*)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\s*\{",
    ],
    "go": [r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b"],
    "rs": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|unsafe\s+|async\s+)*fn\s+([A-Za-z_]\w*)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+([A-Za-z_]\w*)"],
    "cs": [
        r"^\s*(?:public|private|internal|protected|static|sealed|abstract|partial|\s)*\s*(?:class|interface|struct|record|enum)\s+([A-Za-z_]\w*)",
        r"^\s*(?:(?:public|private|internal|protected|static|override|async|virtual)\s+)+[\w<>\[\], ]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?\s*$",
    ],
    "php": [r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?([A-Za-z_]\w*)", r"^\s*(?:(?:abstract|final)\s+)*(?:class|interface|trait)\s+([A-Za-z_]\w*)"],
    "kt": [r"^\s*(?:(?:public|private|internal|override|suspend|inline|open)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?([A-Za-z_]\w*)", r"^\s*(?:(?:public|private|internal|open|data|sealed|abstract|enum)\s+)*(?:class|interface|object)\s+([A-Za-z_]\w*)"],
    "swift": [r"^\s*(?:(?:public|private|internal|static|override|open|mutating)\s+)*func\s+([A-Za-z_]\w*)", r"^\s*(?:(?:public|private|internal|open|final)\s+)*(?:class|struct|enum|protocol|extension)\s+([A-Za-z_]\w*)", r"^\s*(?:(?:public|private|internal|convenience|required|override)\s+)*(init)\s*[?(]"],
    "scala": [r"^\s*(?:(?:override|private|protected|final)\s+)*def\s+([A-Za-z_]\w*)", r"^\s*(?:(?:abstract|final|sealed|case|implicit)\s+)*(?:class|object|trait)\s+([A-Za-z_]\w*)"],
    "rb": [r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", r"^\s*(?:class|module)\s+([A-Z]\w*)"],
}
#: What says that a header is of a type, not of a function.
TYPE_WORDS = re.compile(r"\b(?:class|struct|interface|enum|record|trait|object|protocol|extension|module|union|type|@interface|@implementation|@protocol)\s+(?:\w+\s+)?$|@(?:interface|implementation|protocol)\s+$")
ALIASES = {"ts": "js", "jsx": "js", "tsx": "js", "mjs": "js", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "mm": "m", "kts": "kt"}
KEYWORDS = "if else for while do switch case return break continue try catch finally throw new def class function func fn import from".split()
# The words that a structure keeps; all others, types included, are names.
STRUCTURE_WORDS = """if else while for do switch case default break continue return goto throw try catch finally yield await async
class struct enum interface extends implements import package namespace using typedef typename
public private protected static final const volatile abstract virtual override inline extern synchronized transient native
new delete this self super null nil None true false True False sizeof typeof instanceof is as in not and or xor""".split()
NOT_CALLS = "if for while switch return catch sizeof function def class elif and or not in print import require".split()

SYMBOL = "path string, name string, base_name string, start int, end int, type string"


def mask(source: str) -> str:
    """Comments and the inside of strings become spaces; lines and columns stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", blank, source, flags=re.S)


def _python(source: str) -> list[tuple[str, int, int, str]]:
    out = []

    def walk(node, prefix):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if prefix and isinstance(node, ast.ClassDef) else "function"
                out.append((name, child.lineno, child.end_lineno, kind))
                walk(child, name + ".")
            else:
                walk(child, prefix)

    try:
        walk(ast.parse(source), "")
    except (SyntaxError, ValueError, RecursionError):
        lines = source.split("\n")
        for k, line in enumerate(lines):
            if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line):
                end = k
                for j in range(k + 1, len(lines)):
                    if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j if lines[j].strip() else end
                out.append((m[3], k + 1, end + 1, "class" if m[2] == "class" else "function"))
    return out


def _braced(source: str, ext: str) -> list[tuple[str, int, int, str]]:
    lines = mask(source).split("\n")
    out = []
    for k, line in enumerate(lines):
        for pattern in HEADERS[ext]:
            m = re.match(pattern, line)
            if m and m[1] not in KEYWORDS:
                depth, opened, end = 0, False, k
                for j in range(k, len(lines)):
                    for c in lines[j]:
                        depth += (c == "{") - (c == "}")
                        opened |= c == "{"
                    end = j
                    if opened and depth <= 0 or not opened and (";" in lines[j] or j > k + 5):
                        break
                out.append((m[1], k + 1, end + 1, "class" if TYPE_WORDS.search(line[: m.start(1)]) else "function"))
                break
    return out


def _ended(source: str) -> list[tuple[str, int, int, str]]:
    lines = source.split("\n")
    out = []
    for k, line in enumerate(lines):
        for pattern, kind in zip(HEADERS["rb"], ("function", "class"), strict=True):
            if m := re.match(pattern, line):
                own = len(line) - len(line.lstrip())
                end = next((j for j in range(k + 1, len(lines)) if re.match(rf"\s{{{own}}}end\b", lines[j])), len(lines) - 1)
                out.append((m[1], k + 1, end + 1, kind))
                break
    return out


def parse(path: str, source: str) -> list[tuple[str, int, int, str]]:
    """(name, start, end, type) of the definitions of one file, by its extension."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    ext = ALIASES.get(ext, ext)
    if ext == "py":
        return _python(source)
    if ext == "rb":
        return _ended(source)
    return _braced(source, ext) if ext in HEADERS else []


def _symbols(batches):
    for batch in batches:
        rows = [(p, n, re.split(r"::|\.", n)[-1], a, b, t) for p, c in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for n, a, b, t in parse(p or "", c or "")]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "name", "base_name", "start", "end", "type"])


def symbols(corpus: DataFrame) -> DataFrame:
    """Definitions of a corpus of (path, content); a second one of a name in a file is `name@2`, and so on."""
    found = corpus.select("path", "content").mapInArrow(_symbols, SYMBOL)
    w = Window.partitionBy("path", "name").orderBy("start")
    n = F.row_number().over(w)
    return found.withColumn("name", F.when(n > 1, F.concat_ws("@", "name", n.cast("string"))).otherwise(F.col("name")))


def structure(body: Column) -> Column:
    """Strings, comments, numbers, names and spacing normalised, in this order."""
    out = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*"', '"S"')
    out = F.regexp_replace(out, r"'(?:[^'\\]|\\.)*'", "'C'")
    out = F.regexp_replace(out, r"//[^\n]*", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    for number in (r"0[xX][0-9a-fA-F]+[lLuU]*", r"\b\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?\b", r"\b\.\d+(?:[eE][+-]?\d+)?[fFdD]?\b", r"\b\d+[lLuU]*\b"):
        out = F.regexp_replace(out, number, "0")
    out = F.regexp_replace(out, r"(?<![A-Za-z_0-9])(?!(?:" + "|".join(STRUCTURE_WORDS) + r")(?![A-Za-z_0-9]))[A-Za-z_]\w*", "_")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def bodies(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols with their source text and its hashes."""
    body = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    out = found.join(corpus.select("path", "content"), "path").withColumn("body", body).drop("content")
    return out.withColumns({"body_hash": F.sha1("body"), "struct_hash": F.sha1(structure(F.col("body"))), "lines": F.col("end") - F.col("start") + 1})


def call_sites(corpus: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, line_no, callee, call_type): every name followed by `(` outside comments and strings. With the symbols, the
    lines that define a name are no calls of it; without them, lines shaped like a definition are not looked at."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?m)//[^\n]*$", ""), r"/\*[^*\n]*(?:\*(?!/)[^*\n]*)*\*/", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r'"(?:\\.|[^"\\\n])*"', '""'), r"'(?:\\.|[^'\\\n])*'", "''")
    lines = corpus.select("path", F.posexplode(F.split(bare, "\n", -1)).alias("at", "line"))
    code = lines.where(~F.trim("line").rlike(r"^(/\*|\*|#)"))
    if found is None:
        code = code.where(~F.col("line").rlike(r"^\s*(?:(?:export|async|public|private|protected|static)\s+)*(?:def|class|function|func|fn)\b"))
    hit = code.select("path", (F.col("at") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(r"((?:\.|->|::)?[A-Za-z_]\w*)\s*\("), F.lit(1))).alias("raw"))
    kind = F.when(F.col("raw").rlike("^(\\.|->)"), "member").when(F.col("raw").startswith("::"), "qualified").otherwise("simple")
    out = hit.select("path", "line_no", F.regexp_replace("raw", r"^(\.|->|::)", "").alias("callee"), kind.alias("call_type")).where(~F.col("callee").isin(NOT_CALLS))
    if found is None:
        return out
    return out.join(found.select("path", F.col("start").alias("line_no"), F.col("base_name").alias("callee")), ["path", "line_no", "callee"], "left_anti")


def callers(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Call sites of known names with the innermost function around them, null outside all."""
    sites = call_sites(corpus, found).join(found.select(F.col("base_name").alias("callee")).distinct(), "callee", "left_semi").distinct()
    ranges = found.where("type <> 'class'").select("path", F.col("name").alias("caller"), "start", "end")
    return containing(sites, ranges, ["path"], "line_no", "start", "end", "caller", innermost=True).select("callee", "path", "line_no", "call_type", "caller")


# Import statements by language; group 1 is the module.
IMPORTS = {
    "py": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "js": r"""(?:import\s[^'"]*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\))""",
    "c": r"""^\s*#\s*include\s*(?:<([^>]+)>|"([^"]+)")""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;()",
    "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$()""",
    "rs": r"^\s*(?:pub\s+)?use\s+([\w:]+)()",
    "cs": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;()",
}


def imports(corpus: DataFrame) -> DataFrame:
    """(path, line_no, lang, module), one row per import statement."""
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    lang = ext
    for a, b in ALIASES.items():
        lang = F.when(ext == a, b).otherwise(lang)
    lines = corpus.select("path", lang.alias("lang"), F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    module = F.lit(None).cast("string")
    for name, pattern in IMPORTS.items():
        hit = F.concat(F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2))
        module = F.when((F.col("lang") == name) & (hit != ""), hit).otherwise(module)
    return lines.select("path", (F.col("at") + 1).alias("line_no"), "lang", module.alias("module")).where("module IS NOT NULL")


# What marks a file as vendored, generated or minified, and the tokens of control flow.
NOISE = r"(^|/)(vendor|third_party|node_modules|dist|build|generated)/|\.min\.|\.pb\.|_pb2\.|(^|/)tests?/"
CONTROL = r"\b(if|else|while|for|do|switch|case|return|break|continue|goto|throw|try|catch|finally|yield)\b"
DYNAMIC = r"""\b(?:dlopen|LoadLibrary[AW]?|import|__import__|importlib\.import_module|require)\s*\(\s*([^)]*)\)"""


def is_noise(path: Column, content: Column) -> Column:
    """Vendored, generated, minified or test files, by path or by lines too long to be written by hand."""
    mean = F.length(content) / F.size(F.split(content, "\n", -1))
    return path.rlike(NOISE) | F.coalesce(mean > 300, F.lit(False)) | F.coalesce(F.contains(content, F.lit("DO NOT EDIT")), F.lit(False))


def is_opaque(name: Column) -> Column:
    """Names that say nothing: one or two characters, or letters with digits as minifiers make them."""
    return (F.length(name) <= 2) | name.rlike(r"^[a-zA-Z]{1,2}[0-9]+$|^_0x[0-9a-f]+$")


def code_lines(body: Column) -> Column:
    """Lines left when comments are gone, without blank ones."""
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)/\*.*?\*/", ""), r"(?m)(//|#(?!include|define|if|endif|pragma)).*$", "")
    return F.size(F.filter(F.split(bare, "\n"), lambda s: F.trim(s) != ""))


def tight_structure(body: Column) -> Column:
    """Structure with runs of three or more equal statements as one and their number; null below three control-flow tokens."""
    whole = structure(body)
    parts = F.transform(F.split(whole, ";", -1), lambda p: F.trim(p))
    none = F.array().cast("array<struct<p:string,n:int>>")

    def step(s: Column, p: Column) -> Column:
        last = F.element_at(s, -1)
        one = F.array(F.struct(p.alias("p"), F.lit(1).alias("n")))
        more = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(p.alias("p"), (last["n"] + 1).alias("n"))))
        return F.when(F.size(s) == 0, one).when(last["p"] == p, more).otherwise(F.concat(s, one))

    shown = F.transform(F.aggregate(parts, none, step), lambda r: F.when(r["n"] >= 3, F.concat(r["p"], F.lit("*"), r["n"].cast("string"))).when(r["n"] == 2, F.concat(r["p"], F.lit(" ; "), r["p"])).otherwise(r["p"]))
    return F.when(F.regexp_count(whole, F.lit(CONTROL)) >= 3, F.array_join(shown, " ; "))


def comments(corpus: DataFrame) -> DataFrame:
    """(path, kind, text) of block and line comments."""
    found = [
        corpus.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("text"))
        for kind, pattern in (("block", r"(?s)/\*(.*?)\*/"), ("line", r"(?m)(?:^|\s)//[ \t]*([^\n]*)$"), ("hash", r"(?m)(?:^|\s)#[ \t]+([^\n]*)$"))
    ]
    return found[0].union(found[1]).union(found[2]).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def dynamic_loads(corpus: DataFrame) -> DataFrame:
    """(path, target, literal): run-time loads, and whether their target is a literal."""
    hit = corpus.select("path", F.explode(F.regexp_extract_all("content", F.lit(DYNAMIC), F.lit(1))).alias("target"))
    return hit.withColumn("literal", F.col("target").rlike("""^\\s*['"][^'"]*['"]\\s*(,.*)?$"""))


def word_holes(body: Column) -> Column:
    """Tokens of a body as structs of text and whether it is a word (a hole) or structure."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"[A-Za-z_]\w*|\d[\w.]*|\S"), F.lit(0)), lambda t: F.struct(t.alias("text"), (t.rlike(r"^[A-Za-z_\d]") & ~t.isin(KEYWORDS)).alias("hole")))


def substitutions(a: Column, b: Column) -> Column:
    """Where two bodies of one structure differ: pairs of words, null if their structures do not align."""
    x, y = word_holes(a), word_holes(b)
    shape = lambda v: F.transform(v, lambda t: F.when(t["hole"], F.lit("_")).otherwise(t["text"]))
    pairs = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p["text"].alias("a"), q["text"].alias("b"))), lambda s: s["a"] != s["b"])
    return F.when(shape(x) == shape(y), F.array_distinct(pairs))
