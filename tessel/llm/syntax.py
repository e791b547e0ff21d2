"""Source files that do not parse (problem 5).

Method: *minimum-cost syntax repair by error-correcting chart parsing*. A file is lexed by the rules of its
language (strings, comments, heredocs, regular expression literals and long brackets disappear); what is
left is read against a grammar in three layers: nested brackets and block keywords, expressions of operands and
operators inside each level (``expressions``), and statement forms. Neighbouring partners cancel, which never worsens a
repair, and a chart over the rest finds the least number of inserted, deleted or replaced symbols; every pair of
neighbours that no expression holds, and every fault inside the lexical and statement rules, costs one edit.
Cost zero means the file parses; otherwise the places of the edits tell truncation (only missing ends at
the end of the file), conflict (merge markers), mismatch (another language or binary data) and local faults.

For Python, JSON, JSONC, TOML and YAML the language's own parser decides whether the cost is zero, since
acceptance is a proof of it; the chart then places the repair of what was rejected. A parser that gives up without an
answer (nesting deeper than it goes, or no YAML reader installed) leaves the decision to lexer and chart. Of files with
markup inside code (jsx, tsx) the text between tags is taken out, and lexer, brackets and chart judge the rest.
"""

from __future__ import annotations

import ast
import itertools
import json
import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.expressions import expression_faults

# Extension (lower case) to grammar. Languages named by the extension map of the router.
GRAMMARS = {
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".lua": "lua",
    ".js": "js", ".mjs": "js", ".cjs": "js", ".ts": "ts", ".mts": "ts", ".cts": "ts", ".jsx": "jsx", ".tsx": "jsx",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".hh": "cpp",
    ".sh": "sh", ".bash": "sh", ".zsh": "sh", ".ksh": "sh",
    ".json": "json", ".jsonc": "jsonc", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}

_S, _M = re.DOTALL, re.MULTILINE
_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|>{7}(?: .*)?|\|{7}(?: .*)?|={7})\r?$", _M)
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_FOREIGN = re.compile(r"^\s*(?:<!DOCTYPE\b|<html\b|<\?xml\b|version https?://\S+/spec/v\d|\.\.?/[\w./-]+\s*\Z)", re.IGNORECASE)

# One scanner per family. Groups: c comment, s string, k anything kept as a word, bad: unterminated.
_LEX = {
    "c": r"""(?P<d>^[ \t]*\#[ \t]*(?:error|warning|pragma)\b[^\n]*)|(?P<c>//(?:[^\\\n]|\\.)*|/\*.*?\*/)|(?P<s>R"(?P<q>[^()\\\s]{0,16})\(.*?\)(?P=q)"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+')|(?P<k>(?<!\w)\d(?:'?[\w.])*)|(?P<bad>"|'|/\*|\*/)""",
    "java": r'''(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+')|(?P<bad>"|'|/\*|\*/)''',
    "go": r"""(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+')|(?P<bad>"|'|`|/\*|\*/)""",
    "rust": r"""(?P<c>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*\*/)|(?P<s>\bb?r(?P<q>\#*)".*?"(?P=q)|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\(?:[^xu]|x..|u\{[^}]*\}))')|(?P<k>'\w+(?!'))|(?P<bad>"|'|/\*|\*/)""",
    "js": r"""(?P<c>//[^\n]*|/\*.*?\*/|\A\#![^\n]*)|(?P<s>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<t>`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`(?:[^`\\]|\\.)*`)*\})*`)|(?P<r>(?:(?<=[=(,:\[!&|?{};+*%<>~^\n-])|(?<=return)|(?<=typeof)|(?<=case))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)|(?P<bad>"|'|`|/\*|\*/(?!/))""",
    "lua": r"""(?P<c>\A\#![^\n]*|--\[(?P<q>=*)\[.*?\](?P=q)\]|--[^\n]*)|(?P<s>\[(?P<p>=*)\[.*?\](?P=p)\]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<bad>"|'|\[=*\[)""",
    "ruby": r"""(?P<c>^=begin\b.*?^=end[^\n]*|^__END__$.*|(?<!\\)\#[^\n]*)|(?P<h><<[~-]?(?P<w>["'`]?)(?P<q>[A-Z_]\w*)(?P=w)(?P<rest>[^\n]*)\n(?:.*?\n)??[ \t]*(?P=q)(?=\n|\Z))|(?P<s>"(?:[^"\\#]|\\.|\#(?!\{)|\#\{(?:[^{}]|\{[^{}]*\})*\})*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|%[qQwWiIrx]?(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|\{[^{}]*\}|<[^<>\n]*>|[|!/][^|!/\n]*[|!/]))|(?P<r>(?:(?<=[=(,\[!&|?{};~\n])|(?<=[=(,!&|~] )|(?<=\bif )|(?<=when )|(?<=unless ))/(?![\s*])(?:[^/\\\n]|\\.)*/[a-z]*)|(?P<k>\?[A-Za-z](?!\w))|(?P<bad>"|')""",
    "sh": r"""(?P<c>(?:(?<=[\s;(|&])|(?<![\s\S]))\#[^\n]*)|(?P<h><<-?[ \t]*(?P<w>["'\\]?)(?P<q>\w+)["']?(?P<rest>[^\n]*)\n(?:.*?\n)??[\t]*(?P=q)(?=\n|\Z))|(?P<s>\$?'(?:[^'\\]|\\.|\\)*?'|\$?"(?:[^"\\$`]|\\.|\$\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|\$|`[^`]*`)*")|(?P<k>\$\{(?:[^{}]|\{[^{}]*\})*\}|\\.|\$[\#?$!@*0-9-])|(?P<bad>"|')""",
}
_LEX["cpp"], _LEX["ts"] = _LEX["c"], _LEX["js"]
_SCAN = {k: re.compile(v, _S | _M) for k, v in _LEX.items()}


def _strip(text: str, lang: str) -> tuple[str, int]:
    """The text without comments and with empty strings; and where the first lexical fault is, or -1."""
    bad = [-1]

    def put(m: re.Match) -> str:
        kind = m.lastgroup
        got = m.group()
        if m.group("c") is not None:
            return "\n" if "\n" in got else " "
        if kind == "bad" or m.group("bad") is not None:
            if bad[0] < 0:
                bad[0] = m.start()
            return " "
        if got.startswith("<<") and "rest" in m.groupdict() and m.group("rest") is not None:
            return '""' + m.group("rest")
        if m.groupdict().get("d") is not None:
            return " "
        if m.groupdict().get("k") is not None:
            return " v " if lang == "rust" else "v" if lang in ("sh", "ruby") else "0"
        if m.groupdict().get("t") is not None:
            return "``"
        return '""'

    return _SCAN[lang].sub(put, text), bad[0]


# ---- chart --------------------------------------------------------------------------------------------

_PARTNER = {")": "(", "]": "[", "}": "{"}
#: Later symbols looked through at a time for the next pair that a row of the chart gains by.
_LOOK = 256
#: Sparse rows of repairs of up to d edits take about as much memory as the chart's rows of this many times d symbols.
_SPARSE = 640
#: Cost of pairing a symbol with a later one, by their kinds.
_PAIR = [[2 if one % 2 and not two % 2 else 0 if two == one + 1 and two % 2 else 1 for two in range(6)] for one in range(6)]


def cancel(symbols: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """What is left when neighbouring partners are removed again and again."""
    left: list[tuple[str, int]] = []
    for s in symbols:
        if left and _PARTNER.get(s[0]) == left[-1][0]:
            left.pop()
        else:
            left.append(s)
    return left


def chart(symbols: list[str]) -> tuple[int, list[int]]:
    """Least edits that make ``symbols`` well nested, and which symbols they touch.

    The repair cost of the part from i to before j is the least of these: one symbol alone costs one edit
    (delete it, or insert its partner); a partnered pair costs nothing, any other pair one replacement, or
    two if it closes first and opens second; parts are concatenated. Rows hold the costs of all parts with one start and
    are filled from the last. Where every closing symbol stands before every opening one the least cost is known without a
    chart; runs are shortened, and a long rest is first tried with sparse rows of cheap parts alone, which finds the same
    repair as full rows. There is no bound on the number of symbols: memory grows with the square of those left, time with
    up to its cube, unless few edits do.
    """
    n = len(symbols)
    ends = sum(s in ")]}" for s in symbols)
    if all(s in ")]}" for s in symbols[:ends]):  # no part opens before it closes: two of a kind share one edit
        return -(-ends // 2) - (-(n - ends) // 2), list(range(0, ends, 2)) + list(range(ends, n, 2))
    kinds = ["()[]{}".index(s) for s in symbols]
    kept, gone = _shorten(kinds)
    cost, touched = _chart([kinds[i] for i in kept])
    return cost + len(gone), sorted([*(kept[i] for i in touched), *gone])


def _shorten(kinds: list[int]) -> tuple[list[int], list[int]]:
    """Symbols that the chart needs, and one of each pair of neighbours that a least repair may replace by partners.

    In a run of one opening symbol with q possible partners at most q cost nothing. Of more than 3q + 4 symbols of the run
    two are paired with each other; or two are alone, and may be paired; or two are paired with earlier symbols or three
    next to each other with later ones, at one edit each, and then two of them may be paired with each other and their
    partners likewise. So two neighbours of the run can go at one edit. Closing symbols are the mirror image. A run of
    different symbols of one direction that all have no partner is the same with q = 0.
    """
    n = len(kinds)
    partners = [0] * n
    for order, asks in ((range(n), 1), (range(n - 1, -1, -1), 0)):
        seen = [0, 0, 0]
        for i in order:
            if kinds[i] % 2 == asks:
                partners[i] = seen[kinds[i] // 2]
            else:
                seen[kinds[i] // 2] += 1
    kept: list[int] = []
    gone: list[int] = []
    for _, run in itertools.groupby(range(n), lambda i: kinds[i] if partners[i] else kinds[i] % 2 - 2):
        run = list(run)
        left = len(run) - 2 * max(0, -(-(len(run) - 3 * partners[run[0]] - 4) // 2))
        kept += run[:left]
        gone += run[left + 1 :: 2]
    return kept, gone


def _chart(kinds: list[int]) -> tuple[int, list[int]]:
    """``chart`` of shortened symbols, of which one opens before another closes."""
    n = len(kinds)
    # neighbours that open and close are no partners here, so one of the two is edited, and an edit changes two at most
    limit = -(-sum(one % 2 < two % 2 for one, two in zip(kinds, kinds[1:])) // 2)
    while limit * _SPARSE <= n:
        rows = _sparse_rows(kinds, limit)
        if n in rows[0]:
            return rows[0][n], _places(kinds, lambda i, j: rows[i].get(j, n), lambda i, j, most: sorted(k for k in rows[i + 1] if k < j))
        limit *= 2
    cell = np.int16 if n < 65_000 else np.int32  # no cost is above n / 2 + 1
    kind = np.array(kinds, dtype=np.int8)
    pair = np.array(_PAIR, dtype=cell)[:, kind]
    rows = _full_rows(kinds, pair)
    near = lambda i, j, most: (np.flatnonzero(pair[kinds[i], i + 1 : j] + rows[i + 1][: j - i - 1] <= most) + i + 1).tolist()
    return int(rows[0][n]), _places(kinds, lambda i, j: int(rows[i][j - i]), near)


def _full_rows(kinds: list[int], pair: np.ndarray) -> list[np.ndarray]:
    """The costs of all parts: of the one from i to before j at ``[i][j - i]``.

    A pair (i, k) is followed by further parts only where it is cheaper than every other repair of the part it ends, since
    the cost of concatenated parts never exceeds the sum of theirs.
    """
    n = len(kinds)
    rows = [np.zeros(1, dtype=pair.dtype)] * (n + 1)
    for i in range(n - 1, -1, -1):
        row = np.zeros(n - i + 1, dtype=pair.dtype)
        row[1:] = rows[i + 1] + pair.dtype.type(1)
        closed = pair[kinds[i], i + 1 :] + rows[i + 1][:-1]
        at = 0
        while at < len(closed):
            better = closed[at : at + _LOOK] < row[at + 2 : at + 2 + _LOOK]
            first = int(better.argmax())
            if not better[first]:
                at += _LOOK
                continue
            at += first
            np.minimum(row[at + 2 :], rows[i + at + 2] + closed[at], out=row[at + 2 :])
            at += 1
        rows[i] = row
    return rows


def _sparse_rows(kinds: list[int], limit: int) -> list[dict[int, int]]:
    """The costs of the parts that take up to ``limit`` edits: of the one from i to before j at ``[i][j]``.

    They are exact, since no part of a repair costs more than the whole.
    """
    n = len(kinds)
    rows: list[dict[int, int]] = [{n: 0}] * (n + 1)
    for i in range(n - 1, -1, -1):
        after = rows[i + 1]
        row = {i: 0}
        row.update((j, c + 1) for j, c in after.items() if c < limit)
        for k in sorted(after):
            if k == n:
                break
            closed = after[k] + _PAIR[kinds[i]][kinds[k]]
            if closed < row.get(k + 1, limit + 1):
                for j, c in rows[k + 1].items():
                    if closed + c < row.get(j, limit + 1):
                        row[j] = closed + c
        rows[i] = row
    return rows


def _places(kinds: list[int], cost: Callable[[int, int], int], near: Callable[[int, int, int], list[int]]) -> list[int]:
    """Which symbols a least repair touches; ``near(i, j, most)`` are the symbols before j that may pair with i, in order."""
    touched, todo = [], [(0, len(kinds))]
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        least = cost(i, j)
        if least == cost(i + 1, j) + 1:
            touched.append(i)
            todo.append((i + 1, j))
            continue
        k = next(k for k in near(i, j, least) if cost(i + 1, k) + _PAIR[kinds[i]][kinds[k]] + cost(k + 1, j) == least)
        if _PAIR[kinds[i]][kinds[k]]:
            touched.append(k)
        todo += [(i + 1, k), (k + 1, j)]
    return sorted(touched)


# ---- statement rules ----------------------------------------------------------------------------------

_BRACKET = re.compile(r"[()\[\]{}]")
_JS_WORDS = (
    "abstract|accessor|any|as|assert|asserts|async|await|break|case|catch|class|const|continue|debugger|declare|default|"
    "delete|do|else|enum|export|extends|finally|for|from|function|get|global|if|implements|import|in|infer|instanceof|"
    "interface|is|keyof|let|module|namespace|new|null|of|out|override|private|protected|public|readonly|return|satisfies|"
    "set|static|super|switch|target|this|throw|try|type|typeof|unique|var|void|while|with|yield"
)
_JS_FAULT = re.compile(
    rf"(?<![\w$.#])(?!(?:{_JS_WORDS})\b)[A-Za-z_$][\w$]*[ \t]+(?!(?:{_JS_WORDS})\b)[A-Za-z_$\"]|(?<![\w$.])(?!(?:{_JS_WORDS})\b)[A-Za-z_$][\w$]*\"\""
    r"|^[ \t]*#(?!\w+\s*[=;(\n])|^#|::|:=|->|^[ \t]*<!|\b(?:if|while|switch)[ \t]+[^(\s]|^[ \t]*import[ \t]+[\w.]+[ \t]*$"
    r"|^[ \t]*package\b|^[ \t]*(?:public|private|protected)[ \t]+class\b|^[ \t]*(?:def|fn|func|local|elif)[ \t]+\w"
    r"|=[ \t]*[;)]|[=+*/%&|<>!][ \t]*\Z|\b(?:const|let|var|function|return|new|class|throw)[ \t]*\Z|\bfunction[ \t]+function\b|\b(?:const|let|var)[ \t]+(?:const|let|var)\b",
    _M,
)
_GO_HEAD = re.compile(r"\A\s*package[ \t]+\w+[ \t]*(?:;|\n|\Z)")
_GO_FAULT = re.compile(
    r"::|=>|\b(?:func|package|import|const|var|type)[ \t]+(?:func|package|import|const|var|type)\b(?![ \t]*\()|\bfunc[ \t]+func\b"
    r"|=[ \t]*[;)}\]]|[\w)\]][ \t]+(?:def|fn|class)[ \t]|^[ \t]*(?:def|fn|class|let|use|pub|impl|public|private|local)[ \t]+\w+[^:=\n]*$|#",
    _M,
)
_GO_ITEM = re.compile(
    r"(?:package[ \t]+\w+|import[ \t]+(?:[\w.]+[ \t]+)?(?:\"\"|\(\))|(?:const|var|type)\b(?:[^\n{}()]|\{\}|\(\))*|func\b(?:[^\n{}()]|\{\}|\(\))*"
    r"|[\w.]+(?:[ \t]*,[ \t]*[\w.]+)*[ \t]*:?=(?:[^\n{}()]|\{\}|\(\))*|[\w.]+\(\)(?:\.\w+\(\))*)[ \t]*(?:;|\n|\Z)"
)
_JAVA_ITEM = re.compile(
    r"(?:package|import)\s+(?:static\s+)?[\w.]+(?:\.\*)?\s*;|(?:@[\w.]+\s*(?:\(\))?\s*|\b(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\b\s*)*"
    r"\b(?:class|interface|enum|record|@\s*interface|module|open\s+module)\s+[\w.]+[^;{}]*\{\}|;"
)
_RUST_ITEM = re.compile(
    r"#!?\s*\[\]|(?:\bpub\s*(?:\(\))?\s*)?(?:\b(?:unsafe|async|const|default|extern\s*(?:\"\")?)\s+)*(?:"
    r"\bfn\s+\w+[^;{}]*(?:\{\}|;)|\buse\s[^;]*;|\bmod\s+\w+\s*(?:\{\}|;)|\b(?:struct|enum|union|trait)\s+\w[^;{}]*(?:\{\}|;)|\b(?:unsafe\s+)?impl\b[^;{}]*\{\}"
    r"|\b(?:const|static|type)\s[^;]*;|\bextern\s+crate\s[^;]*;|\bextern\b[^;{}]*\{\}|\bmacro_rules!\s*\w+\s*(?:\{\}|\(\);|\[\];)|(?<![\w:])[\w:]+!\s*\w*\s*(?:\{\}|\(\)\s*;?|\[\]\s*;?))"
)
_RUST_FAULT = re.compile(r":=|\bfn[ \t]+fn\b|=[ \t]*[;)]|\blet[ \t]+let\b|\b(?:def|class|function|func)[ \t]+\w", _M)
_JAVA_FAULT = re.compile(r":=|=[ \t]*[;)]|\b(?:class|public|static|void|int)[ \t]+(?:class[ \t]+class|public)\b|\b(class|void|public|return|import|package)[ \t]+\1\b|#", _M)
_C_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\\\n]|\\.)*)", _M | _S)
_C_DIRECTIVES = frozenset("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line import embed".split()) | {""}
_C_FAULT = re.compile(
    r":=|=>|=[ \t]*[;)]|(?<![\w])(?!(?:extern|return|case|else|throw|co_return|co_yield|operator|delete|static_assert|asm|__asm__)\b)[A-Za-z_]\w*[ \t]+\"\"[ \t]*[;\n]"
    r"|\b(?:def|fn|func|function|local|package|import)[ \t]+[A-Za-z_]\w*|\b(?:let|pub|impl)[ \t]+\w|(?<!for)(?<!for )\([ \t]*\w+[ \t]*:[ \t]*[\w&]|\b(return|if|for|while|struct|class|int)[ \t]+\1\b",
    _M,
)
_RUBY_TOKEN = re.compile(
    r"(?<![\w.:@$])(?:(?P<o>(?:class|module|begin|case)(?![\w?!:])|def(?![\w?!:])(?!\s+(?:self\.)?[\w?!]+[ \t]*(?:\(\))?[ \t]*=(?![=~]))|do(?![\w?!:]))|(?P<e>end(?![\w?!:=]))|(?P<w>(?:while|until|for)(?![\w?!:]))|(?P<i>(?:if|unless)(?![\w?!:])))|(?P<b>[()\[\]{}])"
)
_RUBY_FAULT = re.compile(
    r":=|(?<![:?\w]):[ \t]*$|\w[ \t]*\)[ \t]*:[ \t]*$|^[ \t]*(?:else|try|finally|except\b.*|elif\b.*|if\b.*|for\b.*|while\b.*|class\b.*):[ \t]*$|^[ \t]*<!|^[ \t]*\}[ \t]*(?:else|catch|finally)\b"
    r"|^[ \t]*(?:const|int|long|char|void|static|export|function|func|fn|let|var|package|use|pub|local|impl)[ \t]+[A-Za-z_*&]|\b(def|class|module)[ \t]+\1\b|\bdef[ \t]*$|=[ \t]*\)",
    _M,
)
_LUA_TOKEN = re.compile(r"(?<![\w.:])(?:(?P<o>function|if|do|repeat)|(?P<e>end)|(?P<u>until))(?!\w)|(?P<b>[()\[\]{}])")
_LUA_WORDS = "and|break|do|else|elseif|end|false|for|function|goto|if|in|local|nil|not|or|repeat|return|then|true|until|while"
_LUA_FAULT = re.compile(
    rf"^[ \t]*(?!(?:{_LUA_WORDS})\b)[A-Za-z_]\w*[ \t]+(?!(?:{_LUA_WORDS})\b)[A-Za-z_]|!=|&&|\|\||:=|->|=>|^[ \t]*#|=[ \t]*[;)]|\b(function|local|if|return)[ \t]+\1\b"
    rf"|^[ \t]*(?:{_LUA_WORDS.replace('|', '|')})?[ \t]*if\b(?![^\n]*\bthen\b)(?=[^\n]*[{{:][ \t]*$)|=[ \t]*\Z|^[ \t]*<!",
    _M,
)
_SH_TOKEN = re.compile(
    r"(?:^|(?<=[;&|({!\n])|(?<=\bthen\s)|(?<=\belse\s)|(?<=\bdo\s)|(?<=\bif\s)|(?<=\bwhile\s)|(?<=\buntil\s))[ \t]*(?:(?P<if>if)|(?P<fi>fi)|(?P<do>do)|(?P<done>done)|(?P<case>case)|(?P<esac>esac))(?![\w=./-])"
    r"|(?P<b>[(){}]|\[\[|\]\])",
    _M,
)
_SH_FAULT = re.compile(r"[A-Za-z_][\w.]*\([^)\s]|^[ \t]*<!|^[ \t]*(?:class|import|public|const|let|var|local function|func|fn|def)\b[^\n]*[{:(][ \t]*$|^[ \t]*(?:from|import)[ \t].*[;][ \t]*$|&&[ \t]*$\Z|\|\|?[ \t]*\Z", _M)
_SH_AT = r"(?:^|[;&|({!\n]|\b(?:then|else|do|if|while|until)\s)[ \t]*"
_SH_LOOP = re.compile(_SH_AT + r"(?:for|while|until|select)(?=\s)(?![^\n]*\)[ \t]*$)", _M)
_SH_DO = re.compile(r"(?:^|[;&|({!\n]|\b(?:then|else|do)\s)[ \t]*do(?=\s|$)", _M)
_SH_CASE = re.compile(r"\bcase\b.*?\besac\b", _S)
_SH_PATTERN = re.compile(r"(^|;;|\bin\b)([ \t\n]*)\(?[^()\n;]*\)", _M)


def _collapse(code: str) -> str:
    """``code`` with the content of all well nested brackets removed."""
    out, depth = [], 0
    at = 0
    for m in _BRACKET.finditer(code):
        c = m.group()
        if c in "([{":
            if depth == 0:
                out.append(code[at : m.end()])
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                at = m.start()
            elif depth < 0:
                return code
    if depth:
        return code
    out.append(code[at:])
    return "".join(out)


def _statement_faults(code: str, lang: str) -> int:
    """Edits that the statement rules ask for; brackets are counted elsewhere."""
    if lang == "go":
        faults = bool(_GO_FAULT.search(code)) + (not _GO_HEAD.match(code) and bool(code.strip()))
        return faults + bool(_GO_ITEM.sub("", _collapse(code)).strip())
    if lang == "java":
        return bool(_JAVA_FAULT.search(code)) + bool(_JAVA_ITEM.sub("", _collapse(code)).strip())
    if lang == "rust":
        return bool(_RUST_FAULT.search(code)) + bool(_RUST_ITEM.sub("", _collapse(code)).strip())
    if lang in ("c", "cpp"):
        return _c_faults(code, lang)
    if lang in ("js", "ts"):
        return bool(_JS_FAULT.search(code))
    if lang == "sh":
        return abs(len(_SH_LOOP.findall(code)) - len(_SH_DO.findall(code)))
    return 0


def _c_faults(code: str, lang: str) -> int:
    rest = _collapse(code)
    faults = bool(_C_FAULT.search(code))
    tail = rest.rsplit("}", 1)[-1].rsplit(";", 1)[-1]
    if tail.strip() and not re.fullmatch(r"\s*[A-Z_][A-Z0-9_]*\s*(?:\(\))?\s*", tail):
        faults += 1
    items = [item.strip() for item in re.split(r"(?<=[;}])", rest)]
    for body, after in zip(items, [*items[1:], ""]):
        if body.endswith("{}") and not (lang == "cpp" and after == ";"):  # a value may be built by braces
            if "(" not in body and "=" not in body and not re.search(r"\b(?:struct|class|union|enum|namespace|extern|typedef|concept|requires|export|module)\b", body):
                faults += 1
        elif lang == "c" and re.match(r"[\w ]+\.[\w.]+;", body):
            faults += 1
    return faults


def _directives(code: str) -> tuple[str, int]:
    """C code without preprocessor lines and alternative branches; and how many directives are unknown."""
    unknown, out, at, skip, stack = 0, [], 0, 0, []
    for m in _C_DIRECTIVE.finditer(code):
        if not skip:
            out.append(code[at : m.start()])
        word = m.group(1)
        if word not in _C_DIRECTIVES:
            unknown += 1
        if word in ("if", "ifdef", "ifndef"):
            stack.append(False)
        elif word in ("else", "elif", "elifdef", "elifndef") and stack:
            if not stack[-1]:
                stack[-1] = True
                skip += 1
        elif word == "endif" and stack:
            skip -= stack.pop()
        at = m.end()
    if not skip:
        out.append(code[at:])
    return "\n".join(out), unknown


def _symbols(code: str, lang: str) -> list[tuple[str, int]]:
    """Brackets and block keywords of ``code``; keywords become brackets of their own pairs."""
    if lang == "ruby":
        out, loop_line = [], -1
        for m in _RUBY_TOKEN.finditer(code):
            kind, at = m.lastgroup, m.start()
            if kind == "b":
                out.append((m.group(), at))
            elif kind == "e":
                out.append(("}", at))
            elif kind == "o":
                if m.group() == "do" and loop_line >= 0 and "\n" not in code[loop_line:at]:
                    loop_line = -1
                    continue
                out.append(("{", at))
            else:
                head = code[code.rfind("\n", 0, at) + 1 : at].strip()
                if not head or head[-1] in "=(;|&,{[" or head.endswith(("then", "else", "do", "begin")):
                    out.append(("{", at))
                    if kind == "w":
                        loop_line = at
        return out
    if lang == "lua":
        return [(m.group() if m.lastgroup == "b" else "{" if m.lastgroup == "o" else "}", m.start()) for m in _LUA_TOKEN.finditer(code)]
    if lang == "sh":
        if "case" in code:
            code = _SH_CASE.sub(lambda c: _SH_PATTERN.sub(lambda p: p.group(1) + p.group(2), c.group()), code)
        names = {"if": "(", "fi": ")", "do": "[", "done": "]", "case": "{", "esac": "}", "[[": "[", "]]": "]"}
        return [
            (names.get(m.group().strip(), m.group()) if m.lastgroup == "b" else names[m.lastgroup], m.start())
            for m in _SH_TOKEN.finditer(code)
        ]
    return [(m.group(), m.start()) for m in _BRACKET.finditer(code)]


# ---- languages with a parser at hand ------------------------------------------------------------------


#: The parser gave no answer.
_UNKNOWN = -2


def _parser_fault(text: str, lang: str) -> int | None:
    """Where the language's own parser finds a fault, None if it accepts the text, or ``_UNKNOWN``."""
    try:
        if lang == "python":
            if text.isspace() or not text:
                return None
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif lang == "json":
            json.loads(text)
        elif lang == "jsonc":
            bare = re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or " ", text, flags=_S)
            if bare.strip():
                json.loads(re.sub(r'("(?:[^"\\\n]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", bare))
        elif lang == "toml":
            import tomllib

            tomllib.loads(text.replace("\r\n", "\n"))
        elif lang == "yaml":
            try:
                import yaml
            except ImportError:
                return _UNKNOWN
            loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
            for _ in yaml.parse(text, Loader=loader):
                pass
        return None
    except (RecursionError, MemoryError):
        return _UNKNOWN  # deeper than this parser goes; the chart decides
    except json.JSONDecodeError as e:
        return e.pos
    except SyntaxError as e:
        lines = text.split("\n")
        return sum(len(x) + 1 for x in lines[: max(0, (e.lineno or 1) - 1)]) + (e.offset or 0)
    except ValueError as e:
        m = re.search(r"line (\d+)", str(e))
        return sum(len(x) + 1 for x in text.split("\n")[: int(m.group(1)) - 1]) if m else 0
    except Exception as e:  # noqa: BLE001 - the YAML scanner's own errors
        mark = getattr(e, "problem_mark", None)
        return mark.index if mark is not None else 0


_PLAIN_LEX = {"python": "python", "json": "json", "jsonc": "json", "toml": "json", "yaml": "json"}
_SCAN["python"] = re.compile(r"""(?P<c>\#[^\n]*)|(?P<s>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<bad>"|')""", _S)
_SCAN["json"] = re.compile(r"""(?P<c>//[^\n]*|/\*.*?\*/|(?<=\s)\#[^\n]*)|(?P<s>"(?:[^"\\\n]|\\.)*")|(?P<bad>(?!))""", _S)


#: Text between tags; quotes in it open no string. Braces in it are code.
_MARKUP_TEXT = re.compile(r"(?<![=\s])>[^<>{}();=]*(?=</|<[A-Za-z>]|\{)|(?<=\})[^<>{}();=]*(?=</|<[A-Za-z>])")


_CLOSING_TAG = re.compile(r"</[\w.:-]*\s*>|/>")


def _without_markup(text: str) -> str:
    text = _MARKUP_TEXT.sub(lambda m: ">" if m.group()[:1] == ">" else " ", text)
    return _CLOSING_TAG.sub(" ", text)


def diagnose(text: str, lang: str) -> tuple[int, str, int] | None:
    """``(cost, kind, place)`` of the least repair of ``text``, or None if it parses in ``lang``."""
    if not text.strip():
        return None
    plain = lang in _PLAIN_LEX
    fault = -1
    if plain:
        got = _parser_fault(text, lang)
        if got is None:
            return None
        fault = got
    elif _CONTROL.search(text):
        return 1 + text.count("\x00"), "mismatch", _CONTROL.search(text).start()
    if plain and _CONTROL.search(text):
        return 1 + text.count("\x00"), "mismatch", _CONTROL.search(text).start()
    scan = _PLAIN_LEX.get(lang, "js" if lang == "jsx" else lang)
    code, bad = _strip(_without_markup(text) if lang == "jsx" else text, scan)
    conflict = _CONFLICT.search(code)
    if conflict:
        return len(_CONFLICT.findall(code)), "conflict", text.find(conflict.group())
    if _FOREIGN.match(code) and lang not in ("sh", "yaml"):
        return 1, "mismatch", 0
    unknown = 0
    if lang in ("c", "cpp"):
        code, unknown = _directives(code)
    elif lang == "sh" and re.match(r"\s*<!DOCTYPE", code, re.IGNORECASE):
        return 1, "mismatch", 0
    left = cancel(_symbols(code, lang))
    cost, touched = chart([s for s, _ in left]) if left else (0, [])
    fatal = inner = 0
    if not plain and lang != "jsx":
        fatal = _statement_faults(code, lang) if not left else 0
        inner = expression_faults(code, lang)
        if lang == "ruby":
            fatal += bool(_RUBY_FAULT.search(code))
        elif lang == "lua":
            fatal += bool(_LUA_FAULT.search(code))
        elif lang == "sh":
            fatal += bool(_SH_FAULT.search(code))
    sure = plain and fault != _UNKNOWN
    total = cost + (bad >= 0 and (not plain or sure or lang == "json")) + unknown + fatal + inner + (1 if sure and not cost else 0)
    if not total:
        return None
    if "\x00" in text:
        return total, "mismatch", text.index("\x00")
    if cost and all(left[i][0] in "([{" for i in touched) and not unknown and not inner:
        return total, "truncation", len(text)
    if fatal or unknown:
        return total, "mismatch", 0
    place = fault if fault >= 0 else bad if bad >= 0 else left[touched[0]][1] if touched else 0
    return total, "truncation" if place >= len(text.rstrip()) - 1 else "local", place


def decode(raw: bytes | None) -> str:
    """The text of a file: bytes that are not UTF-8 dropped, a byte-order mark allowed."""
    text = (raw or b"").decode("utf-8", "ignore")
    return (text[1:] if text.startswith("\ufeff") else text).replace("\r\n", "\n")


def unparsable_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(file_path, language, cost, kind, place)`` of files that do not parse; one row per distinct file row.

    Null, empty and blank contents parse, as do files whose name names no language of the grammar table.
    Repeated rows give repeated rows. Extra columns are ignored. A narrow map without a shuffle; files of
    other languages are filtered before Python.
    """
    ext = F.lower(F.regexp_extract(F.col(path_col), r"(\.[^./]+)$", 1))
    narrow = files.where(ext.isin(*GRAMMARS)).select(path_col, content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang = GRAMMARS["." + path.rsplit(".", 1)[1].lower()]
                got = diagnose(decode(raw), lang)
                if got:
                    for c, v in zip(out, (path, lang, *got)):
                        c.append(v)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(out, kinds)],
                names=["file_path", "language", "cost", "kind", "place"],
            )

    return narrow.mapInArrow(run, "file_path string, language string, cost int, kind string, place int")


def fault_rates(files: DataFrame) -> DataFrame:
    """``(namespace, project_id, language, files, faulty, rate)`` over distinct paths of the grammar table.

    A path counts as faulty if any of its rows is. Null namespaces and projects form groups of their own.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in GRAMMARS.items() for x in kv])
    known = files.select("namespace", "project_id", "path", table[ext].alias("language")).where("language IS NOT NULL")
    faults = unparsable_files(files).select(F.col("file_path").alias("path"), F.lit(1).alias("fault"))
    flagged = known.select("namespace", "project_id", "path", "language", F.lit(0).alias("fault")).unionByName(
        faults, allowMissingColumns=True
    )
    per_path = flagged.groupBy("path").agg(
        F.max("namespace").alias("namespace"), F.max("project_id").alias("project_id"),
        F.max("language").alias("language"), F.max("fault").alias("fault"),
    )
    out = per_path.groupBy("namespace", "project_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("fault").alias("faulty")
    )
    return out.withColumn("rate", F.col("faulty") / F.col("files"))
