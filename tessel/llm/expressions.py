"""Expressions and statements of the brace languages, Lua and Ruby, as a grammar over classes of tokens (problem 5).

Code without comments, strings cut to empty ones, becomes one character per token: operand, number, string, operator,
keyword, bracket, separator. Inside a nesting level an expression is operands and operators in turn, a language says
which neighbours else are allowed, and what may end a block. Each pair of neighbours that no derivation holds costs
one edit, for an inserted or deleted symbol between them mends it and it alone.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"[A-Za-z]{0,3}8?(?:\"\"|``)|[A-Za-z_$\u0080-￿][\w$]*|\d[\w.]*|[()\[\]{};,\n]"
    r"|>>>=|<<=|>>=|===|!==|\*\*=|\?\?=|&&=|\|\|=|<=>|\.\.\.|\.\.=|=>|->|::|:=|\.\.|\?\.|\?\?|&\.|\+\+|--|\*\*|&&|\|\||==|!=|~=|=~|!~|<=|>=|[-+*/%&|^]=|&\^=?|<-|<<|>>>|>>|[^\s\w]"
)
# Classes: a operand, n number, s string, t template, K opens a statement, x any other keyword, o binary operator,
# p sign (binary or prefix), m operator that is also a type's mark, u prefix operator, q step, g bracket-like or
# comparison, d joint (path, range, arrow), c colon.
_OPERATORS = {
    "o": "= == === != !== <= >= && || ?? += -= *= /= %= &= |= ^= <<= >>= >>>= **= ??= &&= ||= := ~= / % ** ^ &^ &^= << =~ !~ <=>",
    "p": "+ -", "m": "* & |", "u": "! ~ #", "q": "++ --", "g": "< > >> >>> ?", "d": "-> => :: .. ... ..= ?. &. <- @ \\ `", "c": ":", ".": ".",
}
_CLASS = {op: c for c, ops in _OPERATORS.items() for op in ops.split()}
_VALUES = frozenset("this super null true false nil self Self None undefined nullptr NULL iota".split())
# Keywords of the languages; the first list may open a statement and never goes on with an expression.
_OPENING = {
    "c": "return if for while switch break continue goto do",
    "cpp": "return if for while switch break continue goto do try throw",
    "java": "return if for while switch break continue do try throw int long double float boolean char byte short void final public private protected static",
    "go": "return for switch select defer go break continue goto func var const type",
    "rust": "return let fn use struct while loop break continue mod enum trait impl pub static const",
    "js": "", "ts": "", "lua": "", "ruby": "",
}
_OTHER = {
    "c": "else case default sizeof struct union enum typedef static extern const volatile inline register restrict int char short long float double void signed unsigned auto _Bool bool asm __asm__ __attribute__",
    "cpp": "else case default sizeof struct union enum typedef static extern const volatile inline register int char short long float double void signed unsigned auto bool asm __asm__ __attribute__ class namespace template typename "
    "public private protected virtual override final new delete operator using friend explicit mutable constexpr consteval constinit noexcept decltype static_cast dynamic_cast reinterpret_cast const_cast static_assert catch concept requires "
    "co_await co_return co_yield export import module alignas alignof and or not xor this_thread",
    "java": "else case default class interface enum record extends implements throws new instanceof package import abstract synchronized native transient volatile strictfp catch finally assert yield var permits sealed non when goto const module requires exports opens uses provides with to",
    "go": "else case default package import chan map struct interface range if fallthrough",
    "rust": "if else match for in as where mut ref move dyn async await unsafe extern crate super type box yield union macro_rules default auto",
    "js": "abstract accessor any as assert asserts async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get global if implements import in infer instanceof "
    "interface is keyof let module namespace new of out override private protected public readonly return satisfies set static switch target throw try type typeof unique var void while with yield require",
    "lua": "and break do else elseif end for function goto if in local not or repeat return then until while",
    "ruby": "",
}
_OTHER["ts"] = _OTHER["js"]
_TYPES = "int char short long float double void signed unsigned bool struct union enum typedef static const"
#: Languages in which a line's end may end a statement.
_LINES = frozenset(("go", "js", "ts"))
#: Operators that have further uses in a language and so say nothing there.
_NEUTRAL = {
    "ts": "|", "rust": "| || && ! ^", "js": "", "go": "", "java": "", "c": "", "cpp": "&& ^", "lua": "", "ruby": "",
}
_BINARY = {"js": "* &", "lua": "* / %", "go": "", "c": "", "cpp": "", "java": "", "rust": "", "ts": "", "ruby": ""}

_DANGLING = r"[op]N*(?=[;)\]}]|\Z)"
_DOUBLED = r"[op]N*(?=o)"
_FORBIDDEN = {
    "c": rf"{_DANGLING}|{_DOUBLED}|n(?=[naT])|a(?=n)|[ns](?=K)|[op]a(?=a)|\.(?=[;)\],])",
    "java": rf"{_DANGLING}|{_DOUBLED}|n(?=[nas])|a(?=[ns])|s(?=[nsa])|[ns](?=K)|[op]a(?=a)|\.(?=[;)\],])",
    "go": rf"{_DANGLING}|{_DOUBLED}|n(?=[na])|a(?=n)|[op]a(?=a)|\.(?=[;)\],}}])",
    "rust": rf"{_DANGLING}|{_DOUBLED}|n(?=[nas])|a(?=[ns])|s(?=[nsa])|[ns](?=K)|[op]a(?=a)",
    "js": rf"{_DANGLING}|{_DOUBLED}|n(?=[nas])|a(?=[ns])|s(?=[nsa])|\.(?=[;)\],}}])",
    "lua": rf"{_DANGLING}|[opm]N*(?=o)|n(?=[ns])|a(?=n)|\.(?=[;)\],}}])",
}
_FORBIDDEN |= {"cpp": _FORBIDDEN["c"], "ts": _FORBIDDEN["js"]}
_RULES = {k: re.compile(v) for k, v in _FORBIDDEN.items()}
_RUBY = re.compile(r"(?<=[\w\")\]])[ \t]*(?:[-+/%][ \t]*\*(?!\*?\w)|[-+/%][ \t]*\*[ \t]+\w|(?<![<>=!])=[ \t]+=(?![=~>])|[-+*/%=][ \t]*(?:\n[ \t]*end\b|\Z))")
_OPERATOR_NAME = re.compile(r"\boperator[ \t]*(?:\(\)|\[\]|\"\"[ \t]*\w+|[^\s\w(\[;]+)")
_CAPTURE = re.compile(r"\[[ \t]*[=&](?=[ \t]*[,\]])")
_BLOCK = re.compile(r"[{}]")


def _tables(lang: str) -> dict[str, str]:
    table = dict(_CLASS)
    table |= {op: "g" for op in _NEUTRAL[lang].split()} | {op: "o" for op in _BINARY[lang].split()}
    table |= {w: "a" for w in _VALUES} | {w: "K" for w in _OPENING[lang].split()} | {w: "x" for w in _OTHER[lang].split()}
    if lang in ("c", "cpp"):
        table |= {w: "T" for w in _TYPES.split()}
    return table | {c: c for c in "()[]{};,"} | {"\n": "N" if lang in _LINES else "", '""': "s", "``": "t"}


_TABLE = {lang: _tables(lang) for lang in _FORBIDDEN}


def classes(code: str, lang: str) -> str:
    """The class of each token of ``code``."""
    if lang == "cpp":
        code = _CAPTURE.sub("[", _OPERATOR_NAME.sub("operator_", code))
    table = _TABLE[lang]
    out = []
    for token in _TOKEN.findall(code):
        c = table.get(token)
        if c is None:
            first = token[0]
            c = "n" if first.isdigit() else "t" if token[-1] == "`" else "s" if token[-1] == '"' else "a" if first == "_" or first == "$" or first.isalpha() or first > "\x7f" else "g"
        out.append(c)
    return "".join(out)


def _open_ends(line: str, lang: str) -> int:
    """Blocks of statements whose last statement has no end."""
    faults, stack = 0, []
    for m in _BLOCK.finditer(line):
        at = m.start()
        if m.group() == "{":
            stack.append(at)
        elif stack:
            begin = stack.pop()
            body = line[begin + 1 : at]
            if begin and line[begin - 1] == ")" and body and (body[0] == "K" or body.endswith((";K", "}K"))) and body[-1] not in ";}{:" + ("" if lang == "java" else ")"):
                faults += "{" not in body
    return faults


def expression_faults(code: str, lang: str) -> int:
    """Edits that the expressions and statements of ``code`` need; 0 for languages without rules here."""
    if lang == "ruby":
        return len(_RUBY.findall(code))
    if lang not in _RULES or lang == "rust" and "macro_rules" in code:
        return 0
    line = classes(code, lang)
    return len(_RULES[lang].findall(line)) + (_open_ends(line, lang) if lang in ("c", "cpp", "java") else 0)
