"""Lexer helper for TS/JS text, run per Arrow batch: statements and calls as tokens, in one pass over a text.

``scan`` keeps a stack of open brackets (type arguments count as brackets where a type can stand) and returns

* the statements that declare, import or export, each as written (``raw``) and as a ``skeleton`` of the same
  length, in which comments are blank and whatever lies inside nested brackets, strings and literals is ``FILL``.
  A skeleton has the shape of the statement's head and nothing else, so rules over it are plain patterns;
* the called names with the name of the function declaration around them.

What the statements declare is decided by Spark expressions over the skeletons (``operators/extract_ts.py``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

FILL = "\x01"
SCAN_COLUMNS = ("statements array<struct<kind:string,start:int,line:int,raw:string,skeleton:string,doc:string,top:boolean>>, "
                "calls array<struct<callee:string,caller:string>>, whole boolean")

_LEX = re.compile(r"(\s*)(?:(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?)|(?P<string>'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)"
                  r"|(?P<word>[\w$¡-\U0010ffff]+)|(?P<op>=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|\+\+|--|.|\Z))", re.S)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{)?", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[\w$]*")
_ATOM = r"(?:(?!&&|\|\|)[^<>(){};=]|=>|\{[^{}]*\}|\([^()]*\)|%s)*"
_TYPE_ARGS = re.compile(rf"<{_ATOM % (rf'<{_ATOM % rf"<{_ATOM % r'<>'}>"}>')}>(?=\s*(?:\?\.)?\()")
_CUT = re.compile(r"\n(?=(?:export|function|class|interface|enum|const|let|var|import|declare|abstract)\b)")
_ARROW = re.compile(r"\s*(?::[^;{}]*?)?=>")
_CALLEE = re.compile(r"[a-zA-Z_][\w.]*", re.A)

# Words of the language.
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "void", "delete", "await", "yield", "in", "of",
               "instanceof", "new", "do", "else", "case", "throw", "extends", "implements", "as", "is", "keyof", "infer", "class", "const", "let",
               "var", "export", "default", "satisfies"}
_MODIFIERS = {"export", "default", "declare", "async", "abstract"}
_MEMBER_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "get", "set", "declare", "override", "accessor"}
_DECLARING = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "const": "variable",
              "let": "variable", "var": "variable", "import": "import"}
_REGEX_AFTER = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await"}
_GOES_ON_AFTER = set(",=+-*/%&|^?:(<.!~{[") | {"=>", "&&", "||", "??", "?.", "..."} | _NOT_CALLED - {"void", "return", "function", "class"} | {"type", "interface", "enum", "import", "from"}
_GOES_ON_WITH = set(",=+-*/%&|^?:.)]}>(<[`") | {"=>", "&&", "||", "??", "?."} | {"in", "of", "instanceof", "as", "satisfies", "extends", "implements", "from"}
_OBJECT_AFTER = set("=(,:[?|&<+!~^*%") | {"??", "||", "&&", "...", "return", "in", "of", "typeof", "await", "yield", "default", "throw", "new", "extends", "is", "case", "keyof"}
_CLOSES = {")": "(", "]": "[", "}": "{", ">": "<"}


def _doc(raw: str) -> str | None:
    """Description of a ``/** ... */`` block: gutters stripped, cut at the first tag line."""
    lines = []
    for line in raw[3:-2].split("\n"):
        text = re.sub(r"^\s*\*? ?", "", line.rstrip())
        if re.match(r"^\s*@\w", text):
            break
        lines.append(text)
    return "\n".join(lines).strip() or None


class _Frame:
    """An open bracket: its kind of content, the function around it, and the statement that is being read in it."""

    __slots__ = ("bracket", "at", "kind", "fn", "quiet", "fresh", "first", "doc", "decorated", "case", "statement", "call", "parent_statement", "named_class", "dropped")

    def __init__(self, bracket: str, at: int, kind: str, fn, quiet: bool):
        self.bracket, self.at, self.kind, self.fn, self.quiet = bracket, at, kind, fn, quiet
        self.fresh, self.first, self.doc, self.decorated, self.case = True, None, None, False, False
        self.statement = self.call = self.parent_statement = self.dropped = None
        self.named_class = False


class _Statement:
    """``state`` of a function: head, params, tail; ``typed``: a type may stand here."""

    __slots__ = ("kind", "start", "doc", "top", "name", "state", "typed", "cuts", "exports")

    def __init__(self, kind: str, start: int, doc: str | None, top: bool, exports: bool):
        self.kind, self.start, self.doc, self.top, self.exports = kind, start, doc, top, exports
        self.name, self.state, self.typed, self.cuts = None, "head", kind != "variable", []


def scan(src: str | None) -> tuple[list[tuple], list[tuple]]:
    """Statements (kind, start, line, raw, skeleton, doc, top) and calls (callee, caller) of a text, in order."""
    return scan_block(src)[:2]


def cuts(src: str, size: int) -> list[int]:
    """Where a text may be cut into blocks of at least ``size`` letters: at lines that start with a word that only
    starts statements, so nothing before them goes on there unless a bracket, a comment or a string is open."""
    at = [0]
    while (m := _CUT.search(src, at[-1] + size)) is not None:
        at.append(m.start() + 1)
    return at


def scan_block(src: str | None) -> tuple[list[tuple], list[tuple], bool]:
    """``scan`` of a text that starts at the top level, and whether the next block may be read on its own: nothing is
    open at the end, the last statement is over, and no JSDoc or decorator waits for one."""
    if not src:
        return [], [], True
    statements, calls = [], []
    reading: list[_Statement] = []  # the statements of all frames; a head ends before its body, so they are few
    breaks = [m.start() for m in re.finditer("\n", src)]
    stack = [_Frame("", -1, "block", None, False)]
    at, n = 0, len(src)
    last, last_end, newline, doc = "", 0, True, None  # the token before, its end, whether a line ended since, the JSDoc since
    unclosed = False  # a comment, string or template goes on past the end
    chain = None  # (start, end, whether the whole expression) of the dotted name just read

    def drop(frame: _Frame) -> None:
        if frame.statement:
            reading.remove(frame.statement)
            frame.statement = None

    def finish(frame: _Frame, end: int) -> None:
        s = frame.statement
        drop(frame)
        if s.kind == "type?" or s.kind == "export" and not s.exports:
            return
        raw = src[s.start:end]
        skeleton, done = [], s.start
        for a, b, fill in sorted(s.cuts):
            b = min(b, end)
            if a >= done and b > a:
                skeleton.append(src[done:a] + fill * (b - a))
                done = b
        skeleton.append(src[done:end])
        statements.append((s.kind, s.start, bisect_left(breaks, s.start) + 1, raw, "".join(skeleton), s.doc, s.top))

    def cut(a: int, b: int, fill: str = FILL) -> None:
        """Blank a stretch in the statements that are being read around it."""
        for s in reading:
            s.cuts.append((a, b, fill))

    while at < n:
        frame = stack[-1]
        if frame.bracket == "`":  # the text of a template, up to its end or the next ${
            m = _TEMPLATE.match(src, at)
            cut(at, m.end() - (0 if m[1] is None else len(m[1])))
            unclosed = m[1] is None
            at = m.end()
            if m[1] == "${":
                stack.append(_Frame("{", at - 1, "group", frame.fn, frame.quiet))
                stack[-1].call = "template"
                stack[-1].fresh = False
                last, newline = "(", False
            else:
                stack.pop()
                last, last_end, chain = "`", at, None
            continue
        m = _LEX.match(src, at)
        kind = m.lastgroup
        start, at = m.span(kind)
        token = src[start:at]
        if not newline and m[1] and "\n" in m[1]:
            newline = True
        if not token:
            break
        if kind == "comment":
            unclosed = token[1] == "*" and not (token.endswith("*/") and len(token) > 3)
            newline = newline or "\n" in token
            if token.startswith("/**") and token.endswith("*/") and len(token) > 4:
                doc = (_doc(token),)
            cut(start, at, " ")
            continue
        if token == "/" and (not last or last in _REGEX_AFTER or last in "(,=:[!&|?{};+-*%<>~^" or last in ("=>", "&&", "||", "??", "...")):
            r = _REGEX.match(src, start)
            if r:
                kind, at = "string", r.end()
        if kind == "string":
            unclosed = at == n and (len(token) < 2 or src[n - 1] not in "'\"/" and not src[n - 1].isalnum())
        # -- does the statement before end here?
        s = frame.statement
        if newline and s and last not in _GOES_ON_AFTER and token not in _GOES_ON_WITH and not (token == "{" and s.kind in ("function", "class", "interface", "enum")):
            finish(frame, last_end)
            s = None
        if newline and not s and not frame.decorated and last not in _GOES_ON_AFTER and token not in _GOES_ON_WITH:
            frame.fresh, frame.first, frame.decorated = True, None, False
        if last == "class" and token in ":=":
            frame.named_class = False
        if last == ":" and frame.case:
            frame.fresh, frame.case = True, False
        newline = False
        starts = frame.fresh and frame.kind == "block"
        if kind == "string":
            cut(start + 1, at - 1) if not (s and s.kind == "import" and len(stack) == 1) else None
            frame.fresh, chain, doc = False, None, None
        elif kind == "word":
            if starts and frame.first is None:
                frame.first, frame.doc = start, doc
            doc = None
            if last == "." and chain and chain[1] == start - 1:
                chain = (chain[0], at, chain[2])
            else:
                chain = (start, at, last not in (".", "?.", "#"))
            if token in ("as", "satisfies") and s and s.kind == "variable":
                s.typed = True
            if token == "class" and last != ".":
                frame.named_class = True
            if s and s.kind == "variable" and token == "enum" and s.state == "head":
                s.kind = "enum"
            elif s and s.kind == "type?":
                s.kind = "type" if s.name == "type" else "interface"
            elif s and s.kind == "function" and s.state == "head" and s.name is None and last in ("function", "*"):
                s.name = token
            elif s and s.kind == "export" and s.state == "head" and last == "default":
                s.exports, s.state = True, "done"
            if s and s.kind == "variable" and s.state == "head":
                s.state = "body"
            if starts and token in _MODIFIERS and not (token == "default" and last != "export"):
                if token == "export" and len(stack) == 1:
                    drop(frame)
                    frame.statement = _Statement("export", frame.first, frame.doc[0] if frame.doc else None, True, False)
                    reading.append(frame.statement)
            elif starts and token in _DECLARING:
                what = _DECLARING[token]
                if what == "function" or len(stack) == 1:
                    drop(frame)
                    frame.statement = _Statement("type?" if token in ("type", "interface") else what, frame.first, frame.doc[0] if frame.doc else None, len(stack) == 1, False)
                    frame.statement.name = token if token in ("type", "interface") else None
                    reading.append(frame.statement)
                    if what == "import" and last == "export":
                        drop(frame)
                frame.fresh = frame.decorated = False
            elif starts and token in ("case", "default"):
                frame.case, frame.fresh = True, False
            elif not (frame.decorated and last in ("@", ".")):
                frame.fresh = frame.decorated = False
        else:
            if starts and token == "@":
                if frame.first is None:
                    frame.first, frame.doc = start, doc
                frame.decorated = True
            elif not (starts and frame.decorated and token in ".("):
                frame.fresh = False
            doc = None
            if s and (s.kind == "type?" or s.kind == "import" and last == "import" and token in "(."):
                drop(frame)
                s = None
            if s and s.kind == "export" and last in ("export", "type") and token == "{":
                s.exports = True
            if token == ":" and s:
                s.typed = True
            elif token in ("=", ",") and s and s.kind == "variable":
                s.typed = False
            if s and s.kind == "variable" and s.state == "head":
                s.state = "body"
            if token == "`":
                stack.append(_Frame("`", start, "text", frame.fn, frame.quiet))
                chain = None
                continue
            if token == "<":
                args = _TYPE_ARGS.match(src, start) if chain or last in ("=", "(", ",", "=>") else None
                owner = s or (frame.parent_statement if frame.kind == "params" else None)
                in_type = frame.kind in ("angle", "typed") or owner is not None and owner.kind != "export" and (owner.kind != "variable" and frame.kind != "params" or owner.typed)
                if in_type:
                    stack.append(_Frame("<", start, "angle", frame.fn, True))
                    stack[-1].call = chain
                elif args:
                    cut(start + 1, args.end() - 1)
                    at = args.end()
                    last, last_end = ">", at
                    continue
            elif token in "([{":
                inside = "group"
                fn, quiet, call = frame.fn, frame.quiet or bool(s and s.kind in ("type", "interface")), None
                body = None
                if token == "(":
                    name = src[chain[0]:chain[1]] if chain and (last_end == chain[1] and last != ")" or last in ("?.", ">")) else None
                    if s and s.kind == "function" and s.state == "head":
                        inside, s.state, fn = "params", "params", (s.name,)
                        name = None
                    if name and chain[2] and not quiet and name not in _NOT_CALLED and _CALLEE.fullmatch(name) and not _declares(src, frame, chain[0], last):
                        call = (name, frame.fn[0] if frame.fn else None)
                elif token == "{":
                    inside = "object" if last in _OBJECT_AFTER and not (last == ":" and frame.kind == "block" and starts) else "block"
                    if s and s.kind in ("class", "interface", "enum") or s and s.kind == "function" and s.state == "tail":
                        if not (last in _OBJECT_AFTER or last == "=>" or last == "implements"):
                            body = s
                            inside = {"class": "class", "function": "block"}.get(s.kind, "object")
                            quiet = quiet or s.kind == "interface"
                            fn = (s.name,) if s.kind == "function" else fn
                            finish(frame, last_end)
                    elif frame.named_class and inside == "block":
                        inside = "class"
                    frame.named_class = False
                if call:
                    calls.append(call)
                f = _Frame(token, start, inside, fn, quiet)
                f.parent_statement = s if inside == "params" else None
                f.dropped = len(calls) - 1 if call and name == "async" else None
                f.call = "body" if body or inside == "block" and last != "=>" else None
                if inside == "params":
                    s.typed = False
                stack.append(f)
            elif token in ")]}>":
                if token == ">" and frame.bracket != "<":
                    pass
                else:
                    while len(stack) > 1 and stack[-1].bracket == "<" and token != ">":
                        stack.pop()
                    if len(stack) > 1 and stack[-1].bracket == _CLOSES[token]:
                        done = stack.pop()
                        if done.statement:
                            stack.append(done)
                            finish(done, last_end)
                            stack.pop()
                        frame = stack[-1]
                        owner = frame.statement
                        if done.dropped is not None and _ARROW.match(src, at):
                            calls[done.dropped] = None
                        # What a statement's own brackets hold is cut, but not a function's parameters, lists of imports and exports.
                        if owner and done.kind != "params" and not (owner.kind in ("import", "export") and token == "}"):
                            owner.cuts.append((done.at + 1, start, FILL))
                        if frame.parent_statement is not None and done.at > frame.at:
                            frame.parent_statement.cuts.append((done.at + 1, start, FILL))
                        if done.kind == "params":
                            done.parent_statement.state, done.parent_statement.typed = "tail", True
                        if done.call == "template":
                            cut(done.at + 1, start)
                            continue
                        if token == ">" and isinstance(done.call, tuple):
                            chain, last, last_end = done.call, ">", at
                            continue
                        if token == "}" and frame.kind == "block" and done.call == "body" and not frame.statement:
                            frame.fresh, frame.first, frame.doc, frame.decorated = True, None, None, False
            elif token == ";":
                if s:
                    finish(frame, start)
                frame.fresh, frame.first, frame.doc, frame.decorated = frame.kind in ("block", "class"), None, None, False
            if token == ":" and frame.kind == "params" and frame.parent_statement:
                frame.parent_statement.typed = True
            elif token in ("=", ",") and frame.kind == "params" and frame.parent_statement:
                frame.parent_statement.typed = False
            if token not in (".", "?.", "<"):
                chain = None
        last, last_end = (token if kind != "string" else '"'), at
    top = stack[0]
    whole = len(stack) == 1 and not (top.decorated or top.named_class or top.case) and doc is None and last not in _GOES_ON_AFTER and last not in _MODIFIERS and not unclosed
    for f in stack:
        if f.statement:
            finish(f, last_end)
    return statements, [c for c in calls if c], whole


def _before(src: str, at: int) -> tuple[str, bool]:
    """The character before ``at`` that is no white space, and whether a line ends between."""
    k = at - 1
    while k >= 0 and src[k].isspace():
        k -= 1
    return (src[k] if k >= 0 else ""), "\n" in src[k + 1:at]


def _declares(src: str, frame: _Frame, at: int, last: str) -> bool:
    """Whether a name followed by an opening parenthesis at ``at`` is a member being declared, or follows new or function."""
    c, line = _before(src, at)
    word = _word_before(src, at)
    if word in ("new", "function"):
        return True
    if c == "*" and _word_before(src, src.rindex("*", 0, at)) == "function":
        return True
    if frame.kind == "object":
        return c in "{," or word in _MEMBER_MODIFIERS or c == ";"
    if frame.kind == "class":
        return c in "{;}*" or word in _MEMBER_MODIFIERS or line and c not in "=+-*/%&|^?:(<.,!~[@"
    return False


def _word_before(src: str, at: int) -> str:
    k = at
    while k > 0 and src[k - 1].isspace():
        k -= 1
    j = k
    while j > 0 and (src[j - 1].isalnum() or src[j - 1] in "_$"):
        j -= 1
    return src[j:k]


_STATEMENT = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("line", pa.int32()), ("raw", pa.string()), ("skeleton", pa.string()),
                        ("doc", pa.string()), ("top", pa.bool_())])
_CALL = pa.struct([("callee", pa.string()), ("caller", pa.string())])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns ``statements``, ``calls`` and ``whole`` for the texts in ``content``, beside the other columns."""
    for batch in batches:
        found = [scan_block(text) for text in batch.column("content").to_pylist()]
        others = [n for n in batch.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in others),
             pa.array([[dict(zip(("kind", "start", "line", "raw", "skeleton", "doc", "top"), s, strict=True)) for s in x[0]] for x in found], pa.list_(_STATEMENT)),
             pa.array([[{"callee": a, "caller": b} for a, b in x[1]] for x in found], pa.list_(_CALL)), pa.array([x[2] for x in found], pa.bool_())],
            names=[*others, "statements", "calls", "whole"])


def block_batches(size: int):
    """(project, path, block, line, content): the blocks of each text, with the number of lines before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, path, src in zip(*(batch.column(c).to_pylist() for c in ("project", "path", "content")), strict=True):
                at = cuts(src, size)
                texts = [src[a:b] for a, b in zip(at, [*at[1:], len(src)], strict=True)]
                lines, before = [], 0
                for t in texts:
                    lines.append(before)
                    before += t.count("\n")
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([project] * n, pa.string()), pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(lines, pa.int32()), pa.array(texts, pa.string())],
                                                 names=["project", "path", "block", "line", "content"])
    return run
