"""C# by lexical rules: literals and comments, declarations with their spans, skeletons, slices, sketches, reduction.

No compiler: heads of blocks and statements are told apart by patterns, so code that does not
compile still gives rows, and constructs that only a binder could resolve are taken as written.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from typing import NamedTuple

LITERAL = r'''\$*(?P<quotes>"{3,}).*?(?P=quotes)(?!")|(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)|\$?"(?:[^"\\\r\n]|\\.)*"?|'(?:[^'\\\r\n]|\\.)+\''''
COMMENT = r"//[^\r\n]*|/\*.*?(?:\*/|\Z)"
_SPANS = re.compile(f"(?P<comment>{COMMENT})|(?P<literal>{LITERAL})", re.S)
_ATTRIBUTES = re.compile(r"\A(?:\s*\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\])*\s*")
_TYPE = re.compile(r"\b(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)\s*(<[^(){};]*?>)?\s*(\([^{};]*\))?\s*(:[^{};]*?)?(?=\bwhere\b|\Z)")
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)")
_CALLED = re.compile(r"(~\s*)?([A-Za-z_]\w*)\s*(?:<[^(){};]*>)?\s*\(")
_LAST_NAME = re.compile(r"([A-Za-z_]\w*)\s*\Z")
MODIFIERS = frozenset("public protected internal private static sealed abstract partial readonly virtual override async new unsafe extern const volatile ref required file".split())
PUBLIC = ("public", "protected", "protected internal")


def blanked(text: str, literals: bool = True) -> str:
    """The text with comments, and literals, as spaces; line ends and all places stay."""

    def blank(m: re.Match) -> str:
        return m[0] if m.lastgroup == "literal" and not literals else re.sub(r"[^\r\n]", " ", m[0])

    return _SPANS.sub(lambda m: blank(m) if m["comment"] is not None or literals else m[0], text)


def _outside(head: str) -> str:
    """What stands outside parentheses."""
    inner = None
    while inner != head:
        inner, head = head, re.sub(r"\([^()]*\)", "", head)
    return head


class Declaration(NamedTuple):
    kind: str
    name: str
    #: Names of the types around it, joined by dots; the namespace.
    owner: str
    namespace: str
    access: str
    signature: str
    #: Places of the first sign and behind the last one, and of the body's brace or arrow (or the end).
    start: int
    end: int
    body: int

    @property
    def qualified(self) -> str:
        return ".".join(p for p in (self.namespace, self.owner, self.name) if p)


def access_of(head: str, default: str) -> str:
    found = set(re.findall(r"[a-z]+", head)) & {"public", "protected", "internal", "private"}
    if "public" in found or not found:
        return "public" if found else default
    if {"protected", "internal"} <= found:
        return "protected internal"
    if {"private", "protected"} <= found:
        return "private protected"
    return min(found)


def _member(head: str, owner: str, braced: bool) -> tuple[str, str] | None:
    """Kind and name of a member by the text before its body or end."""
    before = re.split(r"=>|=(?!=)", head, maxsplit=1)[0]
    words = before.split()
    if not words or "delegate" in words or "operator" in words or re.search(r"\bthis\s*\[", before):
        return None
    called = _CALLED.search(before)
    if called:
        if called[1]:
            return None
        return ("constructor" if called[2] == owner and not set(before[: called.start()].split()) - MODIFIERS else "method"), called[2]
    assigned = re.search(r"=>|=(?!=)", head)
    if braced or (assigned and assigned[0] == "=>"):
        name = _LAST_NAME.search(before)
        return (("event" if "event" in words else "property"), name[1].rpartition(".")[2]) if name and len(words) > 1 else None
    if "event" in words:
        return None
    first = _LAST_NAME.search(before.split(",")[0]) if "<" not in before else _LAST_NAME.search(re.sub(r"<.*>", "", before, flags=re.S).split(",")[0])
    return ("field", first[1]) if first and len(words) > 1 else None


def declarations(text: str) -> list[Declaration]:
    """Types, methods, constructors, properties, events with bodies, first names of fields, and members of enums, in order of place."""
    code = blanked(text)
    out: list[Declaration] = []
    stack: list[list] = []  # kind of block, name, declaration without its end
    mark, namespace = 0, ""

    def begin(at: int) -> int:
        return at + len(code[at:]) - len(code[at:].lstrip()) if at < len(code) else at

    def types() -> list[str]:
        return [b[1] for b in stack if b[0] in ("type", "enum")]

    def made(kind: str, name: str, head: str, start: int, end: int, body: int) -> Declaration:
        bare = head[_ATTRIBUTES.match(head).end() :]
        if kind in ("class", "interface", "struct", "enum", "record"):
            found = _TYPE.search(bare)
            signature = " ".join(f"{bare[: found.start()]} {found[1]} {found[2]}{found[3] or ''} {found[5] or ''}".split())
            access = access_of(bare[: found.start()], "internal")
        else:
            signature = text[start:end].splitlines()[0].strip() if end > start else name
            around = next((b for b in reversed(stack) if b[0] in ("type", "enum")), None)
            access = access_of(re.split(r"[(=]", bare, maxsplit=1)[0], "public" if around and around[3] in ("interface", "enum") else "private")
        return Declaration(kind, name, ".".join(types()), namespace, access, signature, start, end, body)

    def enum_members(start: int, end: int) -> None:
        at = start
        for part in code[start:end].split(","):
            bare = part[_ATTRIBUTES.match(part).end() :]
            name = re.match(r"[A-Za-z_]\w*", bare)
            if name:
                first = at + len(part) - len(part.lstrip())
                out.append(made("enum-member", name[0], "", first, at + len(part.rstrip()), at + len(part.rstrip())))
            at += len(part) + 1

    for m in re.finditer(r"[{};]", code):
        at, sign = m.start(), m[0]
        top = stack[-1][0] if stack else "outside"
        head = code[mark:at]
        if top in ("outside", "namespace", "type"):
            bare = head[_ATTRIBUTES.match(head).end() :]
            kind = _TYPE.search(bare)
            typed = kind is not None and not re.search(r"=|\bwhere\b[^:]*\Z", bare[: kind.start()]) and "(" not in bare[: kind.start()]
            if sign == "{":
                start = begin(mark)
                if typed:
                    name = kind[1].split()[0]
                    out.append(made(name, kind[2], head, start, at, at))
                    stack.append(["enum" if name == "enum" else "type", kind[2], len(out) - 1, name, at])
                elif top != "type" and (space := _NAMESPACE.search(bare)):
                    stack.append(["namespace", space[1], None, "", at])
                    namespace = ".".join(b[1] for b in stack if b[0] == "namespace")
                elif top == "type":
                    opened = "=" in _outside(bare)
                    found = _member(bare, stack[-1][1], not opened)
                    if found and not opened:
                        out.append(made(*found, head, start, at, at))
                        stack.append(["body", found[1], len(out) - 1, "", at])
                    else:  # the braces of an initialiser or of a lambda: the statement goes on behind them
                        stack.append(["within" if opened else "other", "", None, "", at])
                        if opened:
                            continue
                else:
                    stack.append(["other", "", None, "", at])
                mark = at + 1
            elif sign == ";":
                start = begin(mark)
                if typed and kind[1].startswith("record"):
                    out.append(made("record", kind[2], head, start, at + 1, at))
                elif top != "type" and (space := _NAMESPACE.search(bare)):
                    namespace = space[1]
                elif top == "type" and (found := _member(bare, stack[-1][1], False)):
                    cut = re.search(r"=>|=(?!=)", code[start:at])
                    out.append(made(*found, head, start, at + 1, start + cut.start() if cut else at))
                mark = at + 1
            else:  # the end of a namespace or type
                if stack:
                    block = stack.pop()
                    if block[2] is not None:
                        out[block[2]] = out[block[2]]._replace(end=at + 1)
                    namespace = ".".join(b[1] for b in stack if b[0] == "namespace") if block[0] == "namespace" else namespace
                mark = at + 1
            continue
        if sign == "{":
            stack.append(["within", "", None, "", at])
        elif sign == "}":
            block = stack.pop()
            if block[0] == "enum":
                stack.append(block)
                enum_members(block[4] + 1, at)
                stack.pop()
            if block[2] is not None:
                # a property's initial value belongs to it
                value = re.match(r"\s*=(?!=)[^;{}]*;", code[at + 1 :]) if out[block[2]].kind == "property" else None
                out[block[2]] = out[block[2]]._replace(end=at + 1 + (value.end() if value else 0))
            if block[0] != "within" or (stack and stack[-1][0] not in ("type", "outside", "namespace")):
                mark = at + 1
    closed = [d._replace(end=max(d.end, d.body)) for d in out]
    return sorted((_signed(d, text) for d in closed), key=lambda d: (d.start, -d.end))


def _signed(d: Declaration, text: str) -> Declaration:
    """Members have the first line of their text as signature."""
    if d.kind in ("class", "interface", "struct", "enum", "record"):
        return d
    lines = text[d.start : d.end].splitlines()
    return d._replace(signature=lines[0].strip() if lines else d.name)


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def of(self, place: int) -> int:
        return bisect_right(self.starts, place)


def symbols(text: str) -> list[tuple]:
    """(kind, name, owner, fqn, access, is_public, signature, start line, end line, tokens, text) of each declaration."""
    lines = Lines(text)
    out = []
    for d in declarations(text):
        body = text[d.start : d.end]
        out.append((d.kind, d.name, d.owner or None, d.qualified, d.access, d.access in PUBLIC, d.signature, lines.of(d.start), lines.of(max(d.start, d.end - 1)), (len(body) + 3) // 4, body))
    return out


TYPES = ("class", "interface", "struct", "enum", "record")


def outline(text: str) -> list[tuple[str, str, list[str]]]:
    """(kind, name, members) of each type, members each once in order."""
    found = declarations(text)
    out = []
    for d in found:
        if d.kind in TYPES:
            path = f"{d.owner}.{d.name}" if d.owner else d.name
            out.append((d.kind, d.name, list(dict.fromkeys(m.name for m in found if m.owner == path and m.kind not in TYPES))))
    return out


def sketch(path: str, text: str, most: int = 40) -> str:
    """The outline of a file as a few lines; empty if it has no types."""
    out = []
    for kind, name, members in outline(text):
        more = f", ... ({len(members) - most} more)" if len(members) > most else ""
        out.append(f"{kind} {name}" + (": " + ", ".join(members[:most]) + more if members else ""))
    return f"// sketch of {path}: outline only, bodies left out\n" + "".join(f"{line}\n" for line in out) if out else ""


def skeleton(text: str, public_only: bool = False) -> str:
    """The text with the bodies of members replaced by ';'; in public mode without members and types that are not visible outside.

    Members of interfaces are visible.
    """
    cuts: list[tuple[int, int, str]] = []
    for d in declarations(text):
        if any(a <= d.start and d.end <= b for a, b, _ in cuts):
            continue
        if public_only and d.access not in PUBLIC:
            cuts.append((d.start, d.end, ""))
        elif d.kind in ("method", "constructor", "property", "event") and d.body < d.end - 1:
            cuts.append((d.start + len(text[d.start : d.body].rstrip()), d.end, ";"))
    for a, b, with_text in sorted(cuts, reverse=True):
        text = text[:a] + with_text + text[b:]
    return re.sub(r"(?m)^[ \t]*\r?\n", "", text)


def thin_skeleton(text: str, chosen: set[str]) -> str:
    """Members of the chosen qualified names, fields and enum members whole, other members as one line of signature, the rest as it is."""
    lines, rows = Lines(text), text.split("\n")
    out, at, heads = [], 1, set()
    for d in declarations(text):
        first, last = lines.of(d.start), lines.of(max(d.start, d.end - 1))
        if d.kind in TYPES:
            heads |= {first, lines.of(d.body)}
            continue
        # a line that also holds the head of its type stays as it is
        if first < at or first in heads:
            continue
        out += rows[at - 1 : first - 1]
        if d.qualified in chosen or d.kind in ("field", "enum-member"):
            out += rows[first - 1 : last]
        else:
            indent = rows[first - 1][: len(rows[first - 1]) - len(rows[first - 1].lstrip())]
            head = " ".join(text[d.start : d.body].split()).rstrip(";").rstrip()
            out.append(f"{indent}{head};")
        at = last + 1
    return "\n".join([*out, *rows[at - 1 :]]).rstrip("\n")


def symbol_slice(text: str, name: str) -> str | None:
    """The text of the first declaration of a simple or qualified name, under the heads of the types around it."""
    found = declarations(text)
    hit = next((d for d in found if name in (d.name, d.qualified, f"{d.owner}.{d.name}")), None)
    if hit is None:
        return None
    around = [d for d in found if d.kind in TYPES and d.start < hit.start and hit.end <= d.end]
    heads = [" ".join(text[d.start : d.body].split()) + " {" for d in around]
    return "\n".join([*heads, text[hit.start : hit.end], *["}"] * len(heads)])


@dataclass(frozen=True)
class Reduction:
    comments: bool = True
    regions: bool = True
    usings: bool = True
    namespaces: bool = True
    aggressive: bool = False
    generated: bool = True


# Signs of generated migrations, the methods whose bodies go, and the noise attributes.
GENERATED_SIGNS = ("Microsoft.EntityFrameworkCore.Migrations", ": Migration", "ModelSnapshot", "MigrationBuilder", "BuildTargetModel")
GENERATED_METHODS = ("Up", "Down", "BuildModel", "BuildTargetModel")
NOISE = (
    "DebuggerDisplay DebuggerStepThrough DebuggerNonUserCode MethodImpl EditorBrowsable Serializable Obsolete GeneratedCode CompilerGenerated ExcludeFromCodeCoverage SuppressMessage "
    "AssemblyVersion AssemblyFileVersion AssemblyTitle AssemblyDescription AssemblyConfiguration AssemblyCompany AssemblyProduct AssemblyCopyright AssemblyTrademark AssemblyCulture"
).split()
COLLAPSED = " /* collapsed generated body */ "


def collapse_generated(text: str) -> str:
    """Files of generated migrations without the bodies of the methods that build a model."""
    if not any(sign in text for sign in GENERATED_SIGNS):
        return text
    bodies = [d for d in declarations(text) if d.kind == "method" and d.name in GENERATED_METHODS and text[d.body : d.body + 1] == "{"]
    for d in sorted(bodies, key=lambda d: -d.body):
        text = text[: d.body + 1] + COLLAPSED + text[d.end - 1 :]
    return text


def reduce_code(text: str, options: Reduction = Reduction()) -> str:
    """Literals are set aside; then comments, directives, usings and namespaces go, and in aggressive mode noise and spaces."""
    if options.generated:
        text = collapse_generated(text)
    kept: list[str] = []

    def aside(m: re.Match) -> str:
        if m["comment"] is not None:
            return "" if options.comments else m[0]
        kept.append(m[0])
        return f"\0{len(kept) - 1}\0"

    text = _SPANS.sub(aside, text)
    # The patterns of each step and what takes their place.
    steps = []
    if options.aggressive:
        steps += [(r"(?m)^\s*#.*", "")]
    elif options.regions:
        steps += [(r"(?m)^\s*#(?:region|endregion)[^\r\n]*", "")]
    if options.usings:
        steps += [(r"(?m)^\s*using\s+(?:\w+\s*=\s*)?[\w.]+;\s*(?:\r?\n)?", "")]
    if options.namespaces:
        steps += [(r"(?m)^\s*namespace\s+[\w.]+\s*(?:;\s*(?:\r?\n)?|\{)", ""), (r"(?m)^(?:\s{4}|\t)", "")]
    if options.aggressive:
        steps += [(r"\[\s*(?:" + "|".join(NOISE) + r")(?:\(.*\))?\s*\]\s*", ""), (r"(?m)^\s*\[assembly:\s*SuppressMessage.*\]\s*$", ""), (r"\bthis\.", "")]
        steps += [(r"\s*([{};,:()=\[\]])\s*", r"\1"), (r"\s+", " ")]
    for pattern, by in steps:
        text = re.sub(pattern, by, text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text).strip()
