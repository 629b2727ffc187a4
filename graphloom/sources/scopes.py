"""Extraction from languages whose blocks nest (X02, X08-X31, X42-X46, X51): braces, or openers and `end`.

Comments and the contents of strings are blanked first, at equal length. Then the blocks are walked
with a stack: the text before an opening brace is its header, which tells a type, a function, a block
that adds to a known type, or a block of no name. Nodes, methods and calls belong to the innermost
type or function around them, however deep. What a language's headers look like is a `Language`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME = r"[A-Za-z_$][\w$]*"
ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"  # parentheses, two more levels inside
GENERIC = r"(?:\s*<[^{}();]*>)?"
#: Words before a parenthesis or a block that name nothing.
PLAIN = frozenset("if for while switch return catch else elseif elif do try new throw sizeof typeof instanceof foreach unless until and or not await yield function fn func fun def super this defined".split())


@dataclass(frozen=True)
class Language:
    """Patterns of one language; every one is tried on a header, the last match counts."""

    types: str  # name in group 1
    functions: tuple[str, ...]  # name in group `n`, for methods outside their type its name in group `t`
    imports: tuple[tuple[str, str], ...] = ()  # pattern over the text, relation
    extends: str | None = None  # list of supertypes in group 1
    implements: str | None = None
    adds: str | None = None  # a block that adds to the type in group 1; its trait, if any, in group 2
    inside: str | None = None  # a statement in a type that takes up another: name in group 1, relation below
    inside_relation: str = "mixes_in"
    declared: str | None = None  # functions without a body, in types
    line: str = "//"
    quotes: str = "\"'`"
    ends: str | None = None  # blocks open by these and close with `end`
    member: str = r"\.|->|::|\?\.|!\."
    by_case: bool = False  # supertypes after one colon: those named like interfaces are implemented
    plain: str = ""  # further words that name nothing


C_LIKE = rf"(?:^|[\s*&>])(?:(?P<t>{NAME})::)?(?P<n>~?{NAME})\s*{ARGS}\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>&* ]+)?(?::[^{{;]*)?$"
TYPED = rf"(?:^|[\s>\]?])(?P<n>{NAME}){GENERIC}\s*{ARGS}\s*(?:(?:throws|where)\s[^{{;]*|:\s*(?:base|this)\s*{ARGS}\s*)?(?:async\*?\s*|sync\*\s*)?$"
JS = Language(
    types=rf"\b(?:class|interface|enum|namespace)\s+({NAME})",
    functions=(
        rf"\bfunction\s*\*?\s*(?P<n>{NAME}){GENERIC}\s*{ARGS}\s*(?::[^{{;=]+)?$",
        rf"(?P<n>#?{NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*(?:{NAME})?\s*{ARGS}|(?:{ARGS}|{NAME})\s*(?::[^=;]+)?=>)\s*$",
        rf"(?:^|[\s;*])(?P<n>#?{NAME}){GENERIC}\s*{ARGS}\s*(?::[^{{;=]+)?$",
    ),
    imports=((r"""(?m)^\s*import\b[^;'"\n]*?["']([^"'\n]+)["']""", "imports_from"), (r"""\brequire\(\s*["']([^"']+)["']\s*\)""", "imports_from"), (r"""(?m)^\s*export\b[^;'"\n]*\bfrom\s*["']([^"']+)["']""", "re_exports")),
    extends=rf"\bextends\s+([\w$.,\s<>]+?)(?:\bimplements\b|$)",
    implements=r"\bimplements\s+([\w$.,\s<>]+)$",
)
LANGUAGES = {
    "js": JS,
    "java": Language(
        types=rf"\b(?:class|interface|enum|record|trigger)\s+({NAME})",
        functions=(TYPED,),
        imports=((r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", "imports"),),
        extends=r"\bextends\s+([\w.,\s<>]+?)(?:\bimplements\b|\bpermits\b|$)",
        implements=r"\bimplements\s+([\w.,\s<>]+?)(?:\bpermits\b|$)",
        declared=rf"(?:[\w<>\[\],.?]+\s+)({NAME})\s*{ARGS}\s*(?:throws[\w\s.,]+)?$",
        plain="synchronized",
    ),
    "cs": Language(
        types=rf"\b(?:class|interface|struct|enum|record)\s+({NAME})",
        functions=(TYPED,),
        imports=((r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", "imports"),),
        extends=rf"\b(?:class|interface|struct|record)\s+{NAME}{GENERIC}\s*(?:{ARGS})?\s*:\s*([\w.,\s<>]+?)(?:\bwhere\b|$)",
        declared=rf"(?:[\w<>\[\],.?]+\s+)({NAME})\s*{ARGS}\s*(?:=>.*)?$",
        by_case=True,
        plain="lock using fixed nameof checked foreach when base",
    ),
    "c": Language(
        types=rf"\b(?:class|struct|union|enum(?:\s+class)?|namespace|@interface|@implementation|@protocol)\s+({NAME})(?=[^()]*$)",
        functions=(C_LIKE,),
        imports=((r"""(?m)^\s*#\s*(?:include|import)\s*[<"]([^>"\n]+)[>"]""", "imports"),),
        extends=rf"\b(?:class|struct)\s+{NAME}\s*(?:final\s*)?:\s*([\w:,\s<>]+)$",
        quotes='"',
    ),
    "go": Language(
        types=rf"\btype\s+({NAME})(?:\[[^\]]*\])?\s+(?:struct|interface)\s*$",
        functions=(rf"\bfunc\s+(?:\(\s*{NAME}\s+\*?(?P<t>{NAME})[^)]*\)\s*)?(?P<n>{NAME})(?:\[[^\]]*\])?\s*{ARGS}[^{{;]*$",),
        imports=((r"""(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)\"""", "imports"), (r"""(?ms)^\s*import\s*\((.*?)^\s*\)""", "imports")),
        inside=rf"^\s*\*?(?:{NAME}\.)?({NAME})\s*$",
        inside_relation="embeds",
        quotes='"`',
    ),
    "rust": Language(
        types=rf"\b(?:struct|enum|union|trait|mod)\s+({NAME})",
        functions=(rf"\bfn\s+(?P<n>{NAME}){GENERIC}\s*{ARGS}[^{{;]*$",),
        imports=((r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "imports"),),
        extends=rf"\btrait\s+{NAME}{GENERIC}\s*:\s*([\w:+\s]+)$",
        adds=rf"\bimpl{GENERIC}\s+(?:(?P<trait>[\w:]+){GENERIC}\s+for\s+)?({NAME}){GENERIC}[^{{;]*$",
        declared=rf"\bfn\s+({NAME}){GENERIC}\s*{ARGS}[^{{;]*$",
        quotes='"',
        plain="match",
    ),
    "kotlin": Language(
        types=rf"\b(?:class|interface|object)\s+({NAME})",
        functions=(rf"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<t>{NAME})\.)?(?P<n>{NAME})\s*{ARGS}[^{{;=]*$",),
        imports=((r"(?m)^\s*import\s+([\w.]+)", "imports"),),
        extends=rf"\b(?:class|interface|object)\s+{NAME}{GENERIC}\s*(?:{ARGS})?\s*:\s*([\w.,\s<>()]+)$",
        plain="when",
    ),
    "scala": Language(
        types=rf"\b(?:class|trait|object)\s+({NAME})",
        functions=(rf"\bdef\s+(?P<n>{NAME})\s*(?:\[[^\]]*\])?\s*(?:{ARGS})*[^{{;]*$",),
        imports=((r"(?m)^\s*import\s+([\w.]+)", "imports"),),
        extends=r"\bextends\s+([\w.]+)",
        implements=r"\bwith\s+([\w.,\s]+(?:\s+with\s+[\w.]+)*)$",
        plain="match",
    ),
    "swift": Language(
        types=rf"\b(?:class|struct|enum|protocol|actor)\s+({NAME})",
        functions=(rf"\bfunc\s+(?P<n>{NAME}){GENERIC}\s*{ARGS}[^{{;]*$", rf"\b(?P<n>init)\??\s*{ARGS}[^{{;]*$"),
        imports=((r"(?m)^\s*import\s+([\w.]+)", "imports"),),
        extends=rf"\b(?:class|struct|enum|protocol|actor)\s+{NAME}{GENERIC}\s*:\s*([\w.,\s<>]+)$",
        adds=rf"\bextension\s+({NAME})[^{{;]*$",
        quotes='"',
        plain="guard",
    ),
    "php": Language(
        types=rf"\b(?:class|interface|trait|enum)\s+({NAME})",
        functions=(rf"\bfunction\s+&?(?P<n>{NAME})\s*{ARGS}[^{{;]*$",),
        imports=((r"(?m)^use\s+([\w\\]+)", "imports"), (r"""\b(?:require|include)(?:_once)?\s*\(?\s*["']([^"']+)["']""", "imports_from")),
        extends=r"\bextends\s+([\w\\,\s]+?)(?:\bimplements\b|$)",
        implements=r"\bimplements\s+([\w\\,\s]+)$",
        inside=r"^\s*use\s+([\w\\]+)\s*$",
        declared=rf"\bfunction\s+&?({NAME})\s*{ARGS}[^{{;]*$",
        plain="match isset unset array list echo empty",
    ),
    "dart": Language(
        types=rf"\b(?:class|mixin|enum|extension)\s+({NAME})",
        functions=(TYPED,),
        imports=((r"""(?m)^\s*(?:import|export)\s+["']([^"']+)["']""", "imports"),),
        extends=r"\bextends\s+([\w.<>]+)",
        implements=r"\bimplements\s+([\w.,\s<>]+)$",
    ),
    "zig": Language(
        types=rf"\bconst\s+({NAME})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)",
        functions=(rf"\bfn\s+(?P<n>{NAME})\s*{ARGS}[^{{;]*$",),
        imports=((r"""@import\("([^"]+)"\)""", "imports"),),
        quotes='"',
    ),
    "powershell": Language(
        types=rf"(?i)\bclass\s+({NAME})",
        functions=(r"(?i)\bfunction\s+(?P<n>[\w-]+)\s*(?:\([^)]*\))?\s*$", rf"(?:^|[\s\]])(?P<n>{NAME})\s*{ARGS}\s*$"),
        imports=((r"(?im)^\s*(?:using\s+module|import-module)\s+(\S+)", "imports"),),
        extends=rf"(?i)\bclass\s+{NAME}\s*:\s*([\w,\s]+)$",
        line="#",
        plain="param process begin end",
    ),
    "ruby": Language(
        types=rf"^\s*(?:class|module)\s+({NAME})",
        functions=(rf"^\s*def\s+(?:self\.)?(?P<n>{NAME}[?!=]?)",),
        imports=((r"""(?m)^\s*require(?:_relative)?\s+["']([^"']+)["']""", "imports"),),
        extends=rf"^\s*class\s+{NAME}\s*<\s*([\w:]+)",
        inside=rf"^\s*(?:include|extend|prepend)\s+({NAME})\s*$",
        line="#",
        quotes="\"'",
        ends=r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$",
    ),
    "lua": Language(
        types=r"(?!)()",
        functions=(rf"^\s*(?:local\s+)?function\s+(?:(?P<t>{NAME})[.:])?(?P<n>{NAME})", rf"^\s*(?:local\s+)?(?:(?P<t>{NAME})\.)?(?P<n>{NAME})\s*=\s*function\b"),
        imports=((r"""\brequire\s*\(?\s*["']([^"']+)["']""", "imports"),),
        line="--",
        quotes="\"'",
        ends=r"\bfunction\b|^\s*(?:if|for|while)\b|^\s*do\b",
        member=r"\.|:",
    ),
    "elixir": Language(
        types=r"^\s*defmodule\s+([\w.]+)",
        functions=(rf"^\s*defp?\s+(?P<n>{NAME}[?!]?)",),
        imports=((r"(?m)^\s*(?:alias|import|use|require)\s+([\w.]+)", "imports"),),
        line="#",
        quotes='"',
        ends=r"\bdo\s*$|\bfn\b(?!.*\bend\b)",
    ),
    "julia": Language(
        types=rf"^\s*(?:mutable\s+)?(?:struct|module|abstract\s+type)\s+({NAME})",
        functions=(rf"^\s*function\s+(?:{NAME}\.)?(?P<n>{NAME}!?)",),
        imports=((r"(?m)^\s*(?:using|import)\s+([\w.]+)", "imports"),),
        extends=rf"\bstruct\s+{NAME}[^<]*<:\s*({NAME})",
        line="#",
        quotes='"',
        ends=r"^\s*(?:(?:mutable\s+)?struct|module|abstract\s+type|function|macro|if|for|while|begin|let|try|quote)\b|\bdo\b",
    ),
}


def masked(text: str, rule: Language) -> str:
    """text with comments blanked, and strings but for their quotes; lengths and line breaks stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    parts = [r"/\*.*?\*/"] if rule.line == "//" else [r"--\[\[.*?\]\]"] if rule.line == "--" else []
    parts.append(re.escape(rule.line) + r"(?!\[\[)[^\n]*" if rule.line == "--" else re.escape(rule.line) + r"[^\n]*")
    strings = [rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in rule.quotes]
    strings.append(r"'(?:\\.[^']*|[^'\\\n])'")  # a character; a lone quote is none
    whole = re.compile(rf"(?s)(?P<c>{'|'.join(parts)})|(?P<s>{'|'.join(strings)})")
    return whole.sub(lambda m: blank(m[0]) if m["c"] is not None else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)


def _last(pattern: str, header: str):
    found = None
    for found in re.finditer(pattern, header):  # noqa: B007
        pass
    return found


def names_in(listed: str) -> list[str]:
    """The plain names of a list of supertypes."""
    bare = listed
    while re.search(r"<[^<>]*>|\([^()]*\)", bare):
        bare = re.sub(r"<[^<>]*>|\([^()]*\)", "", bare)
    words = [re.sub(r"\b(?:public|private|protected|virtual)\b", "", w).strip() for w in re.split(r",|\+|\bwith\b", bare)]
    return [re.split(r"[.\\]|::", w)[-1].strip() for w in words if w]


class Walk:
    """Walks the blocks of one file and writes its records."""

    def __init__(self, out, text: str, rule: Language, slug):
        self.out, self.text, self.rule, self.slug = out, text, rule, slug
        self.clean = masked(text, rule)
        self.stack: list[tuple[str, str]] = [("file", out.file)]
        self.types: dict[str, str] = {}
        self.spans: list[list] = []  # functions: [id, first place of the body, its end]
        self.open: list = []
        self.named: set[int] = set()  # where functions are named, which is no call
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def owner(self, kinds=("file", "type", "function")) -> tuple[str, str]:
        return next(x for x in reversed(self.stack) if x[0] in kinds)

    def type_node(self, name: str, at: int, header: str) -> str:
        home = self.owner()[1]
        me = self.out.node(self.slug(home, name), name, self.line(at))
        self.types.setdefault(name, me)
        self.out.edge(home, me, "contains", self.line(at))
        rule = self.rule
        for pattern, relation in ((rule.extends, "inherits"), (rule.implements, "implements")):
            if pattern and (m := _last(pattern, header)):
                for parent in names_in(m[1]):
                    kind = "implements" if rule.by_case and re.match(r"I[A-Z]", parent) else relation
                    self.relate(me, parent, kind, at)
        return me

    def relate(self, me: str, name: str, relation: str, at: int) -> None:
        if re.fullmatch(r"[\w$]+", name) and (target := self.types.get(name) or self.out.node(self.slug(name), name, self.line(at), source_file="")) != me:
            self.out.edge(me, target, relation, self.line(at))

    def function_node(self, name: str, of: str | None, at: int) -> str:
        kind, home = self.owner()
        if of:
            kind, home = "type", self.types.get(of) or self.out.node(self.slug(self.out.file, of), of, self.line(at))
            self.types.setdefault(of, home)
        self.named.add(at)
        method = kind == "type"
        me = self.out.node(self.slug(home, name), f".{name}()" if method else f"{name}()", self.line(at))
        self.out.edge(home, me, "method" if method else "contains", self.line(at))
        return me

    def enter(self, header: str, at: int, end: int) -> None:
        """Opens the block at `end` whose header begins at `at`."""
        rule, found = self.rule, ("block", "")
        place = lambda m: at + m.start() + len(m[0]) - len(m[0].lstrip())
        if rule.adds and (m := _last(rule.adds, header)):
            name = m.group(m.lastindex) if "trait" in (m.re.groupindex or {}) else m[1]
            me = self.types.get(name) or self.out.node(self.slug(self.out.file, name), name, self.line(place(m)))
            self.types.setdefault(name, me)
            if "trait" in (m.re.groupindex or {}) and m["trait"]:
                self.relate(me, names_in(m["trait"])[0], "implements", place(m))
            found = ("type", me)
        elif m := _last(rule.types, header):
            found = ("type", self.type_node(m[1], at + m.start(1), header[m.start() :]))
        else:
            for pattern in rule.functions:
                m = _last(pattern, header)
                if m and m["n"] not in PLAIN and m["n"] not in rule.plain.split():
                    of = m["t"] if "t" in m.re.groupindex else None
                    found = ("function", self.function_node(m["n"], of, at + m.start("n")))
                    self.spans.append([found[1], end, None])
                    break
        self.stack.append(found)
        self.open.append(len(self.spans) - 1 if found[0] == "function" else None)

    def leave(self, at: int) -> None:
        if len(self.stack) > 1:
            self.stack.pop()
            if (span := self.open.pop()) is not None:
                self.spans[span][2] = at

    def statement(self, part: str, at: int) -> None:
        """A statement without a block, of interest in types only."""
        if self.stack[-1][0] != "type":
            return
        if self.rule.inside and (m := re.search(self.rule.inside, part)):
            self.relate(self.stack[-1][1], names_in(m[1])[0], self.rule.inside_relation, at + m.start(1))
        elif self.rule.declared and (m := re.search(self.rule.declared, part)) and m[1] not in PLAIN and not re.search(r"\breturn\b|=(?!>)", part[: m.start(1)]):
            self.function_node(m[1], None, at + m.start(1))

    def braces(self) -> None:
        by_line = self.rule.inside_relation == "embeds"
        at, deep, outer = 0, 0, []  # start of the header, open parentheses, and both outside the blocks around
        for m in re.finditer(r"[{}();\n]" if by_line else r"[{}();]", self.clean):
            mark = m[0]
            if mark in "()":
                deep = max(0, deep + (1 if mark == "(" else -1))
            elif mark == "{":
                # A block within parentheses, a literal or a callback, does not end the header around it.
                outer.append((at, deep))
                if deep:
                    self.stack.append(("block", ""))
                    self.open.append(None)
                else:
                    self.enter(self.clean[at : m.start()], at, m.end())
                at, deep = m.end(), 0
            elif mark == "}":
                self.statement(self.clean[at : m.start()], at)
                self.leave(m.start())
                before, deep = outer.pop() if outer else (m.end(), 0)
                at = before if deep else m.end()
            elif not deep and (mark == ";" or self.stack[-1][0] == "type"):
                self.statement(self.clean[at : m.start()], at)
                at = m.end()

    def lines(self) -> None:
        at = 0
        for row in self.clean.split("\n"):
            if re.search(self.rule.ends, row):
                self.enter(row, at, at + len(row))
                if re.search(r"\bend\b", row):
                    self.leave(at + len(row))
            elif re.match(r"\s*end\b", row):
                self.leave(at)
            else:
                self.statement(row, at)
            at += len(row) + 1

    def calls(self) -> None:
        """Every call belongs to the innermost function around it."""
        whole = len(self.clean)
        spans = sorted((a, b if b is not None else whole, f) for f, a, b in self.spans)
        around, k = [], 0
        plain = PLAIN | set(self.rule.plain.split())
        member = self.rule.member
        for m in re.finditer(rf"(?:(?P<r>{NAME})\s*(?:{member})\s*|(?P<x>[)\]])\s*(?:{member})\s*)?(?<![\w$])(?P<n>{NAME}[!?]?)(?=\s*\()", self.clean):
            at = m.start("n")
            while k < len(spans) and spans[k][0] <= at:
                around.append(spans[k])
                k += 1
            while around and around[-1][1] <= at:
                around.pop()
            if around and m["n"] not in plain and at not in self.named:
                self.out.call(around[-1][2], m["n"], self.line(at), m["r"] is not None or m["x"] is not None, m["r"])

    def imports(self) -> None:
        for pattern, relation in self.rule.imports:
            for m in re.finditer(pattern, self.text):
                if not self.clean[m.start() : m.end()].strip():
                    continue  # in a comment
                listed = [(x[1], m.start(1) + x.start()) for x in re.finditer(r'"([^"\n]+)"', m[1])] if "\n" in m[1] else [(m[1], m.start(1))]
                for name, at in listed:
                    self.out.edge(self.out.file, self.slug(re.sub(r"^[./@]+", "", name)), relation, self.line(at))

    def run(self):
        self.imports()
        self.lines() if self.rule.ends else self.braces()
        self.calls()
        return self.out.rows


def scope_records(out, text: str, language: str, slug) -> list[dict]:
    """The records of a text in one of LANGUAGES, written to out."""
    return Walk(out, text, LANGUAGES[language], slug).run()
