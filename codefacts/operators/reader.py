"""One pass over a file's text: tokens, segments and the tree of statement parts, with an explicit stack.

A file is one row, and its text goes through :func:`read` once; nothing else in the library sees tokens. What a stack does
(which brace closes which, what stands in what) built-in functions can only say by windows over one row per token or by a
fold that copies its state at every step, so this is the one place of the code reader that runs in Python. It gets
Arrow batches and returns part rows; all patterns on parts, keys, joins and graphs are Spark's.

* token: comment, string, character literal, one of ``{}();`` or a run of anything else
* segment: tokens up to a brace or semicolon outside parentheses; an array initialiser, a lambda's block or an anonymous
  class stays in its statement
* part: a segment cut after each control head, so that ``if (a) return b;`` gives a head and a statement

The reading is lexical: ordinary source comes out right, broken source gives whatever its braces say. Nothing has a
nesting limit. Brackets that stand in ``DEEP`` others of their kind are written as marks in the mask, so that Spark's
patterns, which can't count, need to know few levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language import JAVA, Language
from .lexer import DEEP, MARKS, WORD

NAME = rf"[\p{{L}}\p{{Nl}}\p{{Sc}}\p{{Pc}}][{WORD}]*"
#: Balanced parentheses of any depth (a recursive group; the pattern may stand once in another).
PARENS = r"(?P<paren>\((?:[^()]++|(?&paren))*+\))"
MOST_ROWS = 20_000


class _Patterns:
    """What the reader needs of a language, compiled from its data once per worker.

    Patterns that look for what is rare are the last step: a word or a character that must be there is looked for first.
    """

    def __init__(self, language: Language) -> None:
        tested, bare = "|".join(language.tested), "|".join(language.bare)
        try:
            token = re.compile(language.tokens)  # these patterns name no character classes, and re is the faster one
        except re.error:
            token = regex.compile(language.tokens)
        self.token = token.match
        # a whole segment without comments and literals whose parentheses close and are no deeper than the mask shows them
        marked = re.escape("".join({*(c[0] for c in language.comments), *language.quotes, *language.quote_marks}))
        inner = rf"\([^(){marked}]*+\)"
        for _ in range(DEEP - 1):
            inner = rf"\((?:[^(){marked}]++|{inner})*+\)"
        self.plain = re.compile(rf"([ \n\t\r\f]*+)((?:[^(){{}};{marked}]++|{inner})*+)([;{{}}])").match
        self.head = regex.compile(
            rf"\s*(?:else\s+if\s*{PARENS}|(?:{tested})\s*(?&paren)|(?:{bare})\b|{language.cases}|(?!default\b){NAME}\s*:(?!:))").match
        self.word = regex.compile(rf"\s*({NAME})").match
        self.label = regex.compile(rf"\s*{NAME}\s*:").match
        self.type = regex.compile(rf"(?s)(?:^|[\s)\]])({'|'.join(language.types)})\s+({NAME})").search
        self.created = regex.compile(rf"\b{language.creator}\s+[{WORD}.]+\s*(?:<.*>)?\s*$").search
        self.value_word = regex.compile(rf"\b(?:{'|'.join(language.value_words)})$").search
        self.head_words = ("else", *language.tested, *language.bare)
        self.any_head = language.cases != JAVA.cases  # whose cases end in a colon, as labels do
        self.types = frozenset(language.types)
        self.control = frozenset((*language.nesting, *language.tested, "case", "default"))
        self.nesting = frozenset(language.nesting)
        self.alike = dict(language.alike)
        self.quotes = frozenset(language.quotes)
        self.marks = "".join(language.quote_marks)
        self.marked = frozenset((*(c[0] for c in language.comments), *language.quotes, *language.quote_marks))


_compiled: dict[Language, _Patterns] = {}


def _patterns(language: Language) -> _Patterns:
    found = _compiled.get(language)
    if found is None:
        found = _compiled[language] = _Patterns(language)
    return found


_SIGNS = frozenset("{}();")
_BLANKS = re.compile(r"[ \t\r\f]+")
_BREAKS = re.compile("[ ]*[\n\u0001][ \n\u0001]*")


def squeeze(text: str) -> str:
    """One line: line breaks and comment marks with the blanks around them become one blank."""
    text = text.strip(" \n\u0001")
    return _BREAKS.sub(" ", text) if "\n" in text or "\u0001" in text else text


def _opens_value(mask: str, language: Language, known: _Patterns) -> bool:
    """Whether a brace after this text belongs to an expression."""
    mask = mask.rstrip()
    if mask.endswith(language.value_ends) or (mask.endswith(language.value_words) and known.value_word(mask)):
        return True
    if not mask.endswith(")") or language.creator not in mask:
        return False
    depth = 0
    for i in range(len(mask) - 1, -1, -1):
        depth += (mask[i] == ")") - (mask[i] == "(")
        if not depth:
            return known.created(mask[:i]) is not None
    return False


def shallow(mask: str, opening: str, closing: str, marks: str) -> str:
    """``mask`` with the brackets of one kind that stand in ``DEEP`` others of it as marks; unmatched ones stay."""
    if mask.count(opening) <= DEEP:
        return mask
    out, stack, arrows = list(mask), [], opening == "<"
    for i, c in enumerate(mask):
        if c == opening:
            stack.append(i)
        elif c == closing and stack and not (arrows and mask[i - 1] == "-"):
            start = stack.pop()
            if len(stack) >= DEEP:
                out[start], out[i] = marks
        elif arrows and c in ";{}":
            stack.clear()
    return "".join(out)


def _segments(content: str, language: Language, known: _Patterns) -> tuple[list[tuple], bool]:
    """(text, mask, ender, line) in order, and whether every brace was closed; text and mask are one where no literal and no
    deep parenthesis is."""
    comments, quotes, marks, marked = language.comments, known.quotes, known.marks, known.marked
    out: list[tuple] = []
    texts: list[str] = []
    masks: list[str] = []
    same = True  # texts and masks so far
    since = 0  # where the mask of the present piece begins
    line, breaks, par = 1, 0, 0
    holds: list[bool] = []  # open braces: whether each belongs to an expression
    values = 0
    blanks = any(c in content for c in "\t\r\f")
    step, plain, end, at = known.token, known.plain, len(content), 0
    while at < end:
        # at the start of a segment or behind a comment in it: the rest by one match where it is plain
        found = plain(content, at) if par == 0 and not values else None
        if found:
            lead, text, token = found.groups()
            if texts:
                text = lead + text
            if blanks or "  " in text:
                text = _BLANKS.sub(" ", text)
            if token != "{" or not _opens_value("".join(masks[since:]) + text if texts else text, language, known):
                if token == "{":
                    holds.append(False)
                elif token == "}" and holds:
                    values -= holds.pop()
                if texts:
                    texts.append(text)
                    masks.append(text)
                    whole = "".join(texts)
                    out.append((whole, whole if same else "".join(masks), token, line))
                    line += breaks + text.count("\n")
                    texts, masks, since, same, breaks = [], [], 0, True, 0
                else:
                    if lead:
                        line += lead.count("\n")
                    out.append((text, text, token, line))
                    if "\n" in text:
                        line += text.count("\n")
                at = found.end()
                continue
        while at < end:
            found = step(content, at)
            if found is None:  # a sign no pattern of the language names
                at += 1
                continue
            token, at = found.group(), found.end()
            if token in _SIGNS:
                if token == "(":
                    if par >= DEEP:
                        masks.append(MARKS[0])
                        same = False
                    else:
                        masks.append("(")
                    texts.append("(")
                    par += 1
                elif token == ")":
                    if par > DEEP:
                        masks.append(MARKS[1])
                        same = False
                    else:
                        masks.append(")")
                    texts.append(")")
                    par -= 1
                elif par > 0:
                    texts.append(token)
                    masks.append(token)
                else:
                    if token == "{":
                        value = _opens_value("".join(masks[since:]), language, known)
                        holds.append(value)
                        values += value
                    ends = not values
                    if token == "}":
                        if holds:
                            values -= holds.pop()
                        else:
                            ends = True
                    if ends:
                        text = "".join(texts)
                        out.append((text, text if same else "".join(masks), token, line))
                        texts, masks, since, same = [], [], 0, True
                        line += breaks
                        breaks = 0
                        break
                    texts.append(token)
                    masks.append(token)
                    since = len(masks)
                continue
            if token[0] not in marked:
                clean = _BLANKS.sub(" ", token) if blanks or "  " in token else token
                breaks += clean.count("\n")
            elif token.startswith(comments):
                n = token.count("\n")
                clean = "\n" * n if n else "\u0001"
                breaks += n
                if par == 0 and not values:
                    texts.append(clean)
                    masks.append(clean)
                    break
            elif len(token) > 1 and (token[0] in quotes or token.lstrip(marks)[:1] in quotes):
                texts.append(token)
                masks.append('"' + "s" * (len(token) - 2) + '"')
                same = False
                breaks += token.count("\n")
                continue
            else:
                clean = _BLANKS.sub(" ", token) if (blanks or "  " in token) and token[0] not in quotes else token
                breaks += clean.count("\n")
            texts.append(clean)
            masks.append(clean)
    text = "".join(texts)
    out.append((text, text if same else "".join(masks), "", line))
    return out, not holds


def _may_head(mask: str, known: _Patterns) -> bool:
    """Whether a control head or a label can be at the start; most statements have none."""
    return known.any_head or ":" in mask or mask.lstrip().startswith(known.head_words)


def _header_kind(mask: str, known: _Patterns) -> str:
    """Keyword of a type's header before a brace, else ``plain``."""
    for word in known.types:
        if word in mask:
            found = known.type(mask)
            kind = found.group(1) if found else "plain"
            return known.alike.get(kind, kind)
    return known.alike.get("plain", "plain")


def _cut(mask: str, ender: str, known: _Patterns) -> list[tuple[str, int, int]]:
    """(kind, start, length) of the heads of a segment and of what follows them."""
    out, at, some, rest = [], 0, False, mask
    while rest and _may_head(rest, known):
        match = known.head(mask, at)
        if not match:
            break
        text = match.group()
        word = known.word(text)
        kind = word.group(1) if word else ""
        if kind == "else" and text.endswith(")"):
            kind = "elseif"
        elif kind not in ("else", "try", "default") and (known.label(text) or kind not in known.control):
            kind = "label"
        kind = known.alike.get(kind, kind)
        if kind != "label":  # a label only names what follows it
            out.append((kind, at, len(text)))
        at, some = match.end(), True
        rest = mask[at:]
    if (not some and ender == "{") or rest.strip(" \n\u0001"):
        kind = _header_kind(rest, known) if ender == "{" else known.alike.get("plain", "plain")
        out.append((kind, at, len(rest)))
    return out


#: Nearest type around a level, the member of it on the way, the kinds below that, and what rows there say of all this:
#: nothing is around the outermost.
_OUTSIDE = (-1, None, (), (None, None, None, None, False, ()))


def _below(around: list[tuple], last: list[tuple[int, str] | None], types: frozenset[str]) -> tuple:
    """What stands around a part one level below those of ``around``."""
    k = len(around) - 1
    up, method, inside, _ = around[k]
    part = last[k]
    if part and part[1] in types:
        up, method, inside = k, None, ()
    elif up < 0:
        method, inside = None, ()
    elif k == up + 1:
        method, inside = part[0] if part else None, ()
    else:
        kind = part[1] if part else None
        inside = inside if kind in inside else (*inside, kind)
    owner = last[up] if up >= 0 else (None, None)
    return up, method, inside, (part[0] if part else None, *owner, method, up == k, inside)


def read(content: str, language: Language = JAVA) -> Iterator[tuple]:
    """The parts of a file in order: (ord, level, kind, opens, text, mask, line, parent_ord, owner_ord, owner_kind, method_ord,
    member, inside).

    ``kind`` is the keyword of a head or of a type's header, and ``plain`` otherwise. ``owner`` is the nearest type around a
    part, ``method`` the member of it the part stands in, ``inside`` the kinds between that member and the part, each once,
    so that a part is as long in deep nesting as in shallow. A file whose braces do not match gives one part of kind ``error``
    that says why, as a parser would fail on it.
    """
    known = _patterns(language)
    types, nesting = known.types, known.nesting
    rows: list[tuple] = []
    depth, ordinal, added = 0, 0, 0
    chains: dict[int, int] = {}  # per depth: levels of the ifs that a following else continues
    tries: dict[int, int] = {}
    braces: list[int] = []  # levels each open brace adds beyond its own
    before: dict[int, str | None] = {}  # kind of the last part at each level
    last: list[tuple[int, str] | None] = []  # the last part at each level
    around: list[tuple] = [_OUTSIDE]  # per level, what stands around a part there; those after a new part are dropped
    deep = [b for b in (("<", ">", 2), ("[", "]", 4), ("{", "}", 6)) if content.count(b[0]) > DEEP]

    def add(level: int, kind: str, opens: bool, text: str, mask: str, line: int) -> None:
        above = max(level, 0)
        if len(around) <= above:
            while len(last) < above:
                last.append(None)
            while len(around) <= above:
                around.append(_below(around, last, types))
        rows.append((ordinal, level, kind, opens, text, mask, line, *around[above][3]))
        if level >= 0:
            if len(last) == level:
                last.append(None)
            last[level] = (ordinal, kind)
            if len(around) > level + 1:
                del around[level + 1 :]

    segments, balanced = _segments(content, language, known)
    for text, mask, ender, line in segments:
        same = text is mask
        for opening, closing, at in deep:
            if mask.count(opening) > DEEP:
                mask = shallow(mask, opening, closing, MARKS[at : at + 2])
                same = False
        if not _may_head(mask, known):  # one part or none
            clean = squeeze(mask)
            if clean or ender == "{":
                kind = _header_kind(mask, known) if ender == "{" else known.alike.get("plain", "plain")
                level = depth + added
                ordinal += 1
                before[level] = kind
                if ender == "{":
                    braces.append(0)
                lead = len(mask) - len(mask.lstrip(" \n\u0001"))
                add(level, kind, ender == "{", clean if same else squeeze(text), clean,
                    line + mask.count("\n", 0, lead) if lead else line)
        else:
            cut = _cut(mask, ender, known)
            first_kind, lent = (cut[0][0] if cut else "close"), 0
            is_else, nested = first_kind in ("else", "elseif"), 0
            ifs = -1
            for sub, c in enumerate(cut):
                if c[0] == "if":
                    ifs = sub
            for sub, (kind, start, size) in enumerate(cut):
                off = -1 if kind in ("case", "default") else nested
                nested += kind in nesting
                if is_else and not sub:
                    lent = chains.get(depth, 0)
                if sub == ifs:
                    chains[depth] = (chains.get(depth, 0) if is_else else 0) + off
                off += lent
                if first_kind in ("catch", "finally"):
                    off += tries.get(depth, 0)
                if kind == "try":
                    tries[depth] = off
                opens = ender == "{" and sub == len(cut) - 1
                level = depth + off + added
                ordinal += 1
                tail = kind == "while" and not opens and before.get(level) == "do"
                before[level] = kind
                if opens:
                    braces.append(off + (kind == "switch"))
                    added += braces[-1]
                if tail:  # the condition that ends a do loop is not a loop of its own
                    continue
                raw = mask[start : start + size]
                clean = squeeze(raw)
                lead = start + len(raw) - len(raw.lstrip(" \n\u0001"))
                add(level, kind, opens, clean if same else squeeze(text[start : start + size]), clean,
                    line + mask.count("\n", 0, lead) if lead else line)
            if ender == "{" and not cut:
                braces.append(0)
        if ender == "{":
            depth += 1
        elif ender == "}":
            ordinal += 1
            before[depth + added] = None
            depth -= 1
            if not braces:
                balanced = False
                break
            added -= braces.pop()
    if balanced and not depth:
        yield from rows
    else:
        yield (1, 0, "error", False, "braces do not match", "", rows[0][6] if rows else 1, None, None, None, None, False, [])


_PART = [
    ("ord", T.LongType(), pa.int64()), ("level", T.IntegerType(), pa.int32()), ("kind", T.StringType(), pa.string()),
    ("opens", T.BooleanType(), pa.bool_()), ("text", T.StringType(), pa.string()), ("mask", T.StringType(), pa.string()),
    ("line", T.IntegerType(), pa.int32()), ("parent_ord", T.LongType(), pa.int64()), ("owner_ord", T.LongType(), pa.int64()),
    ("owner_kind", T.StringType(), pa.string()), ("method_ord", T.LongType(), pa.int64()), ("member", T.BooleanType(), pa.bool_()),
    ("inside", T.ArrayType(T.StringType()), pa.list_(pa.string())),
]


def parts(sources: DataFrame, language: Language = JAVA) -> DataFrame:
    """Part rows of files ``(file_id, content)``; a null content is an empty file. Nothing is shuffled."""
    kept = [f for f in sources.schema if f.name == "file_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owner, rows = batch.column("content"), [], []
            for i in range(batch.num_rows):
                found = list(read(texts[i].as_py() or "", language))
                owner += [i] * len(found)
                rows += found
                if len(rows) >= MOST_ROWS or i == batch.num_rows - 1:
                    columns = zip(*rows, strict=True) if rows else [[] for _ in _PART]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("file_id").take(pa.array(owner, pa.int64()))]
                        + [pa.array(list(c), kind) for c, (_, _, kind) in zip(columns, _PART, strict=True)],
                        ["file_id", *(name for name, _, _ in _PART)])
                    owner, rows = [], []

    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind, _ in _PART)])
    return sources.select("file_id", F.col("content").cast("string").alias("content")).mapInArrow(run, schema)
