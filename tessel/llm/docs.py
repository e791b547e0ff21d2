"""Functions paired with their documentation (problem 3).

Method: *lexed tokens exploded into rows, then windows*. A lexer turns each file into one row per line with
its kind (code, comment, string, blank), its block openings and closings and whether a function's head
stands on it. The rest is relational:

* a running sum of openings minus closings is the depth of each line; the next line at the depth of a head
  ends its function (lead over path and depth);
* consecutive comment lines are islands (line number minus row number), and a lag over a path's
  significant lines attaches an island to the head right below it; for Python the island of string lines
  right after the head is attached.

Documentation is the given docstring or, where it is null or blank, the attached comment. It is trivial if,
without markup, tag names, placeholders and directives to tools, fewer than three different words are left
that are no parts of the function's name or parameters, or, in scripts without spaces, fewer than six
characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.filters import bit_map, passes
from tessel.llm.syntax import _SCAN, GRAMMARS, _symbols, decode

_LEXED = frozenset(("python", "go", "java", "rust", "ruby", "lua", "js", "ts", "jsx", "c", "cpp", "sh"))
_MARK, _MORE = "\x01", "\x02"  # stand for a string in masked code, and for its further lines
_PY_HEAD_END = re.compile(r":[ \t]*$|\)[ \t]*(?:->[ \t]*[^:]+)?:[ \t]+\S")

_HEADS = {
    "python": re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"),
    "go": re.compile(r"func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)"),
    "java": re.compile(r"[ \t]*(?:@\w+[ \t]+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>]*>[ \t]+)?[\w.<>\[\],? ]+[ \t]+(\w+)[ \t]*\([^;]*$"),
    "rust": re.compile(r"[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|unsafe|const|extern[ \t]+\S+)[ \t]+)*fn[ \t]+(\w+)"),
    "ruby": re.compile(r"[ \t]*def[ \t]+(?:self\.)?([\w?!=]+)"),
    "lua": re.compile(r"[ \t]*(?:local[ \t]+)?function[ \t]+([\w.:]+)"),
    "js": re.compile(
        r"[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\*?[ \t]*(\w+)|[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)]*\)[ \t]*=>|\w+[ \t]*=>)"
        r"|[ \t]+(?:(?:static|async|get|set|public|private|protected)[ \t]+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)[ \t]*\([^;]*\)[^;=]*\{[ \t]*$"
    ),
    "c": re.compile(r"(?![ \t]*(?:return|else|if|for|while|switch|case|throw|new|delete|using|typedef)\b)[ \t]*(?:[\w:<>,~\[\]]+[ \t*&]+)+([\w:~]+)[ \t]*\([^;]*\)?[^;]*$"),
    "sh": re.compile(r"[ \t]*(?:function[ \t]+([\w-]+)|([\w-]+)[ \t]*\([ \t]*\))"),
}
_HEADS["ts"] = _HEADS["jsx"] = _HEADS["js"]
_HEADS["cpp"] = _HEADS["c"]
_LEADER = re.compile(r"^[ \t]*(?:///?!?|/\*+!?|\*+/|\*(?!\w)|#+!?|---?|--\[=*\[|\]=*\]|=begin\b|=end\b|;+)?[ \t]?|[ \t]*(?:\*+/|\]=*\])?[ \t\r]*$")
_PY_QUOTES = re.compile(r"^[ \t]*[rRuUbBfF]{0,2}(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')[ \t\r]*$")

#: ``file`` and ``twin`` are a 128-bit hash of the path, which only rows with a head carry.
ROW = "file bigint, twin bigint, path string, indented boolean, version bigint, ln int, kind string, opens int, closes int, head string, head_at int, note string"
FILE = ["file", "twin"]
#: Files a task remembers to have lexed, so copies of a hot file leave it once.
_SEEN_FILES = 100_000


def lex_lines(text: str, lang: str) -> list[list]:
    """Columns ln, kind, opens, closes, head, head_at, note with a row per line; lines count from 0.

    Of a stretch of lines of one kind that open, close, begin and note nothing only the first and the last are
    given: no run of lines starts or ends between them.

    ``kind``: ``b`` blank, ``c`` comment, ``s`` string (Python), ``x`` code. ``head`` is the name of a function
    whose head ends on the line and began at ``head_at``.
    """
    scan = _SCAN["js" if lang == "jsx" else lang]

    def mask(m: re.Match) -> str:
        got = m.group()
        lines = got.count("\n")
        if m.group("c") is not None:
            return "\n" * lines
        groups = m.groupdict()
        if groups.get("k") is not None or groups.get("bad") is not None:
            return "v" if groups.get("k") is not None else " "
        if groups.get("rest") is not None:
            return _MARK + groups["rest"] + "\n" * lines
        return "\n".join([_MARK] + [_MORE] * lines)

    raw, code = text.split("\n"), scan.sub(mask, text)
    masked = code.split("\n")
    n = len(masked)
    opens, closes = [0] * n, [0] * n
    if lang == "python":
        stack, depth, heads = [0], 0, {}
        for i, line in enumerate(masked):
            bare = line.strip()
            if bare and not depth and bare[0] != _MORE:
                indent = len(line) - len(line.lstrip())
                while indent < stack[-1]:
                    stack.pop()
                    closes[i] += 1
                if indent > stack[-1]:
                    stack.append(indent)
                    opens[i] += 1
            depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
    else:
        starts = [0]
        for line in masked:
            starts.append(starts[-1] + len(line) + 1)
        at = 0
        for symbol, place in _symbols(code, lang):
            while at + 1 < n and starts[at + 1] <= place:
                at += 1
            if symbol in "{([" if lang in ("sh", "ruby", "lua") else symbol == "{":
                opens[at] += 1
            elif symbol in "})]" if lang in ("sh", "ruby", "lua") else symbol == "}":
                closes[at] += 1
    find = _HEADS[lang]
    kinds, heads, begins, notes = [], [], [], []
    pending, nested = None, 0
    for i, line in enumerate(masked):
        bare = line.strip()
        text_line = raw[i] if i < len(raw) else ""
        head = head_at = note = None
        if not bare:
            kind = "c" if text_line.strip() else "b"
            if kind == "c":
                note = _LEADER.sub("", text_line)
        elif not bare.strip(_MARK + _MORE + " rRuUbBfF") and lang == "python" and not pending:
            kind, note = "s", _PY_QUOTES.sub("", text_line).rstrip()
        else:
            kind = "x"
            m = find.match(line) if pending is None or lang == "python" and not nested else None
            if m:  # a head that never ends is given up when the next one begins
                pending, nested = (next(g for g in m.groups() if g), i), 0
            if pending is not None:
                nested += sum(map(bare.count, "([")) - sum(map(bare.count, ")]"))
                done = bool(_PY_HEAD_END.search(bare)) if lang == "python" else "{" in bare or lang in ("ruby", "lua", "sh") or bare.endswith((";", "}"))
                if done:
                    head, head_at = pending if not bare.endswith(";") else (None, None)
                    pending = None
        kinds.append(kind)
        heads.append(head)
        begins.append(head_at)
        notes.append(note)
    idle = [k if k in "xb" and not o and not c and h is None else None for k, o, c, h in zip(kinds, opens, closes, heads)]
    keep = [i for i in range(n) if idle[i] is None or i == 0 or i == n - 1 or not idle[i - 1] == idle[i] == idle[i + 1]]
    return [keep, *([column[i] for i in keep] for column in (kinds, opens, closes, heads, begins, notes))]


def lexed_rows(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The lexed lines of ``files(path, content)``; of different contents of a path one counts, the largest by hash.

    Files are lexed where they lie and only their lines are shuffled, by path, for all later windows at once. Files
    whose path is not in the only column of ``wanted`` may be left out; a filter of fixed size decides.
    """
    bits = None
    if wanted is not None:
        bits = files.sparkSession.sparkContext.broadcast(bit_map(wanted.select(F.xxhash64(wanted.columns[0]))))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    known = [k for k, v in GRAMMARS.items() if v in _LEXED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                if bits is not None:
                    part = part.filter(pa.array(passes(part.column(2).to_numpy(), bits.value)))
                cols: list[list] = [[] for _ in names]
                for path, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    version = int.from_bytes(hashlib.blake2b(raw or b"", digest_size=8).digest(), "big", signed=True)
                    if (path, version) in seen:
                        continue
                    if len(seen) >= _SEEN_FILES:
                        seen.clear()
                    seen.add((path, version))
                    text = decode(raw)
                    if "\x00" not in text:
                        lang = GRAMMARS["." + path.rsplit(".", 1)[1].lower()]
                        lexed = lex_lines(text, lang)
                        named = hashlib.blake2b(path.encode(), digest_size=16).digest()
                        one = [int.from_bytes(named[:8], "big", signed=True), int.from_bytes(named[8:], "big", signed=True), lang == "python", version]
                        first, second, indented, versions = ([x] * len(lexed[0]) for x in one)
                        paths = [path if h is not None else None for h in lexed[4]]
                        for column, values in zip(cols, (first, second, paths, indented, versions, *lexed)):
                            column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    lexed = files.where(ext.isin(*known)).select("path", "content", F.xxhash64("path")).mapInArrow(run, ROW).repartition(*FILE)
    latest = F.max("version").over(Window.partitionBy(*FILE))
    again = F.lag("ln").over(Window.partitionBy(*FILE).orderBy("ln"))
    one = lexed.withColumn("latest", latest).where("version = latest").withColumn("again", again)
    return one.where("again IS NULL OR again <> ln").drop("version", "latest", "again")


def line_runs(rows: DataFrame) -> DataFrame:
    """``(file, twin, path, first, last, kind, depth, head, head_at, doc)``: runs of consecutive lines of one kind and depth.

    A running sum of openings minus closings is the depth of each line. Gaps and islands: a running count of the changes
    numbers the runs; a head ends its run. One shuffle by path serves this and every later window.
    """
    order = Window.partitionBy(*FILE).orderBy("ln")
    change = F.col("opens") - F.col("closes")
    # indentation opens before its line, brackets after theirs
    depth = F.sum(change).over(order) - F.when(F.col("indented"), F.lit(0)).otherwise(change)
    deep = rows.withColumn("depth", F.when(F.col("kind").isin("x", "s"), depth))
    same = F.col("kind").eqNullSafe(F.lag("kind").over(order)) & F.col("depth").eqNullSafe(F.lag("depth").over(order)) & F.lag("head").over(order).isNull()
    numbered = deep.withColumn("change", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("change").over(order))
    note = F.when(F.col("kind").isin("c", "s"), F.struct("ln", "note"))
    return numbered.groupBy(*FILE, "run").agg(
        F.max("path").alias("path"), F.any_value("indented").alias("indented"),
        F.min("ln").alias("first"), F.max("ln").alias("last"), F.any_value("kind").alias("kind"), F.any_value("depth").alias("depth"),
        F.max("head").alias("head"), F.max("head_at").alias("head_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]), "\n").alias("doc"),
    ).drop("run")


def located_spans(rows: DataFrame) -> DataFrame:
    """``(file_path, name, first, last, doc)`` of the functions in lexed ``rows``; lines from 0, ``doc`` may be null.

    The next significant line as deep as a head ends its function (lead over path and depth). Python functions carry the
    string that the next significant run is (lead), others the comment run directly above their first line (lag).
    """
    runs = line_runs(rows).withColumn("code", F.col("kind").isin("x", "s"))
    every = Window.partitionBy(*FILE).orderBy("first")
    significant = Window.partitionBy(*FILE, "code").orderBy("first")
    level = Window.partitionBy(*FILE, "code", "depth").orderBy("first")
    noted = F.when((F.lag("kind").over(every) == "c") & (F.col("first") == F.col("head_at")), F.lag("doc").over(every))
    inner = F.when(F.lead("kind").over(significant) == "s", F.lead("doc").over(significant))
    marked = runs.withColumns({"above": noted, "within": inner, "prior": F.lag("last").over(significant), "end": F.max("last").over(significant.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ended = marked.withColumn("until", F.lead("prior").over(level)).where("head IS NOT NULL")
    return ended.select(
        F.col("path").alias("file_path"), F.col("head").alias("name"), F.col("head_at").alias("first"),
        F.when(F.col("until").isNull(), F.col("end")).otherwise(F.greatest("until", "last")).alias("last"),
        F.when(F.col("indented"), F.col("within")).otherwise(F.col("above")).alias("doc"),
    )


def function_spans(files: DataFrame) -> DataFrame:
    """As ``located_spans``, of ``files(path, content)``."""
    return located_spans(lexed_rows(files))


# ---- triviality ---------------------------------------------------------------------------------------

# Directives to tools, tags and placeholders.
_DIRECTIVE = re.compile(
    r"\b(?:pylint|flake8|mypy|pyright|ruff|bandit|isort|yapf|fmt|black|rubocop|standard|luacheck|selene|stylua|shellcheck|eslint|tslint|jshint|jslint|prettier|biome|istanbul|c8|v8|"
    r"golangci|golint|nolint|gosec|staticcheck|clippy|rustfmt|clang-format|clang-tidy|cppcheck|checkstyle|spotbugs|pmd|sonar|coverage|pragma|cspell|codespell)\b[ \t]*[:\-][^\n]*"
    r"|\b(?:eslint|tslint|prettier|istanbul|c8|v8|clang-format|clang-tidy)[- ](?:disable|enable|ignore|on|off)[^\n]*|\bnoqa\b[^\n]*|\btype:[ \t]*ignore[^\n]*|\bNOSONAR\b|\bNOLINT\w*[^\n]*|\bnolint\b[^\n]*|\bnosec\b[^\n]*"
    r"|@ts-(?:ignore|expect-error|nocheck)[^\n]*|@SuppressWarnings[^\n]*|\bgo:(?:generate|build|noinline|embed)\b[^\n]*|#(?:region|endregion)[^\n]*|\bcoding[:=][ \t]*[\w-]+|SPDX-License-Identifier:[^\n]*",
    re.IGNORECASE,
)
_TAG = re.compile(
    r"\{@\w+[^}]*\}|[@\\](?:param|arg|argument|return|returns|throws|exception|raises|raise|see|since|author|version|deprecated|internal|inheritdoc|override|brief|details|note|example|type|yield|yields|prop|property|private|public|protected|todo|ref|code|link|tparam|retval|\w+)\b(?:[ \t]*\{[^}\n]*\})?(?:\[(?:in|out|in,out)\])?"
    r"|:(?:param|type|returns?|rtype|raises?|yields?|var|ivar|cvar|keyword|arg|meta|class|func|meth|ref|mod|obj|attr)\b[^:\n]{0,60}:"
    r"|^[ \t]*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Throws|Yields|Examples?|Notes?|See Also|Attributes)[ \t]*:?[ \t]*$",
    re.IGNORECASE | re.MULTILINE,
)
_PARAM_TAG = re.compile(r"(:(?:param|type|var|ivar|keyword|arg|raises?)\b)([^:\n]{0,60})(:)", re.IGNORECASE)
_BLANKS = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|TBC|WIP|N/A|NA|lorem ipsum|placeholder|to be (?:documented|done|written)|add (?:docs?|documentation|description)(?: here)?|document(?:ation)? (?:me|this)|description here|insert description)\b", re.IGNORECASE)
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&\w+;|https?://\S+|```\w*|[`*_#=~|]{2,}")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f]")
_PARENS = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)")


def _parts(name: str) -> set[str]:
    """Parts of a name: split at marks and capitals, and the runs unsplit."""
    out = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", name))}
    return out | {w.lower() for w in _WORD.findall(name)}


def parameter_names(signature: str | None) -> set[str]:
    """Names of the parameters in a signature of any of the languages."""
    out: set[str] = set()
    groups = _PARENS.findall(signature or "")
    for group in groups:
        for piece in re.split(r",(?![^<\[(]*[>\])])", group):
            piece = piece.split("=", 1)[0]
            words = re.findall(r"[^\W\d]\w*", piece.split(":", 1)[0] if ":" in piece and "::" not in piece else piece)
            if words:
                out.add(words[-1] if ":" in piece or not (signature or "").startswith("func") else words[0])
    return out


def own_words(doc: str, name: str | None, params: list | None, signature: str | None) -> tuple[int, int]:
    """Different words of ``doc`` that are its own, and its characters in scripts without spaces."""
    text = _DIRECTIVE.sub(" ", doc)
    text = _PARAM_TAG.sub(lambda m: " " + m.group(2).split(" ")[-1] + " ", text)
    text = _TAG.sub(" ", text)
    text = _BLANKS.sub(" ", _MARKUP.sub(" ", text))
    known = {"self", "this", "cls"} | _parts(name or "")
    for p in [*(params or []), *parameter_names(signature)]:
        known |= _parts(p or "")
    words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", text)) if not _DENSE.search(w)}
    return len(words - known), len(_DENSE.findall(text))


def is_trivial(doc: str | None, name: str | None = None, params: list | None = None, signature: str | None = None) -> bool:
    """Fewer than three own words and fewer than six characters of scripts without spaces."""
    if not doc or not doc.strip():
        return True
    words, dense = own_words(doc, name, params, signature)
    return words < 3 and dense < 6


def documented_functions(functions: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_path, ord, name, signature, doc)`` of functions whose documentation is not trivial.

    One row per ``(file_path, ord)``; of different repeated rows the one with the longest, then the largest docstring
    counts. A function that lacks one gets the comment of the function that lexing delimits at its line; only files with
    such functions are lexed. Files missing from ``files`` leave only the docstring. Null names, params and signatures count as without parts.
    """
    blank = F.coalesce(F.regexp_replace("docstring", r"(?U)[\s\p{C}]+", ""), F.lit("")) == ""
    best = functions.select("file_path", "ord", "name", "line", "signature", "docstring", "params")
    size = F.coalesce(F.length("docstring"), F.lit(-1))
    best = best.groupBy("file_path", "ord").agg(
        F.max(F.struct(size.alias("size"), "docstring", "name", "line", "signature", "params")).alias("f")
    ).select("file_path", "ord", "f.*").drop("size")
    given = best.where(~blank).withColumn("doc", F.col("docstring"))
    lacking = best.where(blank)
    spans = located_spans(lexed_rows(files, functions.where(blank).select("file_path"))).where("doc IS NOT NULL").select("file_path", F.col("first").alias("at"), "doc")
    python = F.lower("file_path").rlike(r"\.py[wi]?$")
    keyed = lacking.withColumn("at", F.when(python, F.col("line") - 1).otherwise(F.col("line")))
    found = keyed.join(spans.groupBy("file_path", "at").agg(F.max("doc").alias("doc")), ["file_path", "at"]).drop("at")
    both = given.unionByName(found).select("file_path", "ord", "name", "signature", "params", "doc")
    kind = both.schema["ord"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            keep = [not is_trivial(d, n, p, s) for _, _, n, s, p, d in zip(*cols)]
            yield batch.filter(pa.array(keep, type=pa.bool_())).drop_columns(["params"])

    return both.mapInArrow(run, f"file_path string, ord {kind}, name string, signature string, doc string")
