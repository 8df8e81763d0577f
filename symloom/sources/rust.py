"""Rust sources to symbol tables: a lexer and a reader of items and bodies, run over files in Arrow batches.

A file is parsed on its own, so the scan is one map over ``binaryFile`` rows and needs no shuffle. Lines count from 1. A file that
cannot be read to its end gives the symbols up to there. ``parse`` returns plain rows by table; ``scan`` gives one DataFrame whose rows are
(table, JSON), and ``tables`` splits it into the typed tables of ``model.SCHEMAS``. A scan holds one file's text and tokens (some 20 bytes a token and each
word once) and hands its rows on after every top-level item, so a file's symbols are never held together.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.text import ACTOR_ENDS, ACTOR_PARTS, ACTOR_TRAITS, MACRO_KINDS, NON_ACTOR_FRAMEWORKS, OTHER_MACRO, SPAWN_CONTEXTS, TEST_FILE
from symloom.model import SCHEMAS

#: One token or stretch between tokens: every place of a text matches. A comment with one inside, or without an end, is only begun.
LEX = re.compile(
    r"""(///[^\n]*|\s+|//[^\n]*|/\*(?:[^*/]+|\*(?!/)|/(?!\*))*+\*/|/\*|b?r(\#*)".*?"\2|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\\n])'|'[A-Za-z_]\w*"""
    r"""|(?:r\#)?[^\W\d]\w*|\d[\w]*(?:\.\d\w*)?|::|->|=>|\.\.=?|.)""",
    re.S | re.X,
)
COMMENT = re.compile(r"/\*|\*/")
# Words that are no callee.
NO_CALL = frozenset("if while match for return loop in let else move as fn impl where unsafe async await dyn ref mut box yield break continue struct enum use mod pub crate static const type trait".split())
# Methods that spawn an actor of the type before them, and module functions (module, module, function; None: any) that spawn their argument.
SPAWNS = ("spawn", "spawn_with_mailbox", "spawn_link", "spawn_in_thread", "spawn_with_storage")
MODULE_SPAWNS = (
    ("kameo", "actor", "spawn"),
    ("kameo", "actor", "spawn_with_mailbox"),
    ("actix", "actor", "spawn"),
    ("actix", "spawn", None),
    ("riker", "actor", "spawn"),
    ("bastion", None, "spawn"),
    ("coerce", None, "spawn"),
)
MAKERS = ("new", "default", "create")
LIKELY_VARIABLE = r"_(actor|supervisor|worker|handler|agent|service)$|actor_|supervisor_|manager_"
SENDS = {"tell": "Tell", "do_send": "Tell", "ask": "Ask", "send": "Ask"}
CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
BRACKETS = frozenset("()[]{}")


#: Raised whenever the reader gives other rows for the same file, so that kept scans are not taken for its own.
READER = 3


#: Token kinds; between tokens is white space and comments.
END, DOC, STR, LIFE, ID, NUM, OP, BETWEEN = range(8)
NO_ACTORS = frozenset(NON_ACTOR_FRAMEWORKS)


class Kinds(dict):
    """The kind of each text that LEX finds, by its beginning."""

    def __missing__(self, text: str) -> int:
        first = text[0]
        if first == "/" and text[1:2] in ("/", "*"):
            kind = DOC if text.startswith("///") or text.startswith("/**") and text[3:4] not in ("/", "*") else BETWEEN
        elif first.isspace():
            kind = BETWEEN
        elif text[-1] in "\"'#" and len(text) > 1:
            kind = STR
        elif first == "'" and len(text) > 1:
            kind = LIFE
        elif first.isalnum() or first == "_":
            kind = NUM if DIGIT.match(first) else ID
        else:
            kind = OP
        self[text] = kind
        return kind


#: Longer sources are not cut at once, so that their texts are not held together.
AT_ONCE = 100_000
DIGIT = re.compile(r"\d")


def lexed(source: str) -> Iterable[str]:
    """The texts that make up the source; block comments nest, and one that is not closed goes on to the end."""
    found = [t for t, _ in LEX.findall(source)] if len(source) < AT_ONCE else ["/*"]
    return nested(source) if "/*" in found else found


def nested(source: str) -> Iterator[str]:
    """The same text by text, also where a comment holds another or has no end."""
    at = 0
    while at < len(source):
        for m in LEX.finditer(source, at):
            if m[0] == "/*":
                begin, depth, at = m.start(), 1, m.end()
                while depth:
                    mark = COMMENT.search(source, at)
                    if mark is None:
                        at = len(source)
                        break
                    depth += 1 if mark[0] == "/*" else -1
                    at = mark.end()
                yield source[begin:at]
                break
            yield m[0]
        else:
            return


class Scope(NamedTuple):
    names: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    type_name: str | None = None
    trait_name: str | None = None
    context: str = "Free"
    function: str | None = None
    function_name: str | None = None
    test: bool = False
    distributed: bool = False


def module_prefix(path: str) -> tuple[str, ...]:
    inner = re.sub(r"\.rs$", "", path.replace("\\", "/").rpartition("/src/")[2] if "/src/" in path else path.rpartition("/")[2])
    parts = [p for p in inner.split("/") if p]
    if parts and parts[-1] in ("lib", "main", "mod"):
        parts.pop()
    return tuple(p.replace("-", "_") for p in parts)


def pascal(x: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in x.split("_"))


def likely_actor(name: str) -> bool:
    if name in NON_ACTOR_FRAMEWORKS or name in ACTOR_TRAITS or not name[:1].isupper():
        return False
    return name.endswith(ACTOR_ENDS) or any(p in name for p in ACTOR_PARTS)


def spawn_context(function: str | None) -> str:
    if function is None:
        return "module_level"
    return f"{next((kind for kind, p in SPAWN_CONTEXTS if re.search(p, function)), 'regular_function')}:{function}"


@lru_cache(4096)
def in_test(path: str, function: str | None) -> bool:
    """A file of tests, or a function that is named as one or as a part of one."""
    name = function or ""
    inner = path.rpartition("/src/")[2] if "/src/" in path else "/".join(path.rsplit("/", 2)[1:])
    return "test" in inner or re.search(TEST_FILE, path) is not None or "test" in name or name.startswith("setup_") or "mock" in name


class Reader:
    def __init__(self, source: str, path: str, crate: str):
        self.path, self.crate = path, crate
        self.rows: dict[str, list[dict]] = {k: [] for k in ("functions", "types", "modules", "imports", "impls", "raw_calls", "macros", "actors", "spawns", "message_types", "handles", "sends")}
        self.named: list[tuple[str, bool]] = []  # name and whether it is async, of the functions so far of the block that is read
        self.texts, self.kinds, self.lines = texts, kinds, lines = [], bytearray(), array("i")
        line, words, kind_of = 1, {}, Kinds()
        for text in lexed(source):
            kind = kind_of[text]
            if kind != BETWEEN:
                texts.append(words.setdefault(text, text))
                kinds.append(kind)
                lines.append(line)
            if kind < LIFE or kind == BETWEEN:
                line += text.count("\n")
        self.n = len(self.texts)
        texts += ["", ""]
        kinds += bytes(2)
        lines.extend((line, line))
        self.after = self.groups()
        self.actor_of, self.message_of = self.variables()

    def groups(self) -> array:
        """Of each token that opens a group by a bracket, the place after the group: what closes no open group is passed over, and an open group ends with the file."""
        after, opened = array("i", bytes(4 * self.n)), []
        for i, t in enumerate(self.texts):
            if t in BRACKETS:
                if (close := CLOSE.get(t)) is not None:
                    opened.append((i, close))
                elif opened and opened[-1][1] == t:
                    after[opened.pop()[0]] = i + 1
        for i, _ in opened:
            after[i] = self.n
        return after

    def variables(self) -> tuple[dict[str, str], dict[str, str]]:
        """(variable or field -> actor it refers to, variable -> type it is declared or made as), over the whole file."""
        actors: dict[str, str] = {}
        types: dict[str, str] = {}
        for i in [i for i, t in enumerate(self.texts) if t == "let" or t == "ActorRef"]:
            t = self.texts[i]
            if t == "ActorRef" and self.text(i + 1) == "<":
                k = i
                while self.text(k - 1) == "::":
                    k -= 2
                while self.text(k - 1) == "<":  # Option<ActorRef<..>> and the like
                    k -= 2
                    while self.text(k - 1) == "::":
                        k -= 2
                while k > 0 and (self.text(k - 1) in ("&", "mut") or self.kinds[k - 1] == LIFE):
                    k -= 1
                if self.text(k - 1) == ":" and self.kinds[k - 2] == ID:
                    end = self.past(i + 1) - 1
                    name, actor = self.text(k - 2), re.sub(r"<.*", "", self.join(i + 2, end)).split("::")[-1]
                    actors[name] = actor
                    if name.endswith("_ref"):
                        actors.setdefault(name.removesuffix("_ref"), actor)
            elif t == "let":
                k = i + 1 + (self.text(i + 1) == "mut")
                if self.kinds[k] != ID:
                    continue
                name, k = self.text(k), k + 1
                if self.text(k) == ":" and self.kinds[k + 1] == ID and self.text(k + 2) == "=":
                    types[name] = self.text(k + 1)
                if self.text(k) != "=":
                    continue
                parts, k = [self.text(k + 1)], k + 2
                while self.text(k) == "::" and self.kinds[k + 1] == ID:
                    parts.append(self.text(k + 1))
                    k += 2
                if len(parts) > 1 and parts[-1].startswith("spawn") and parts[-2][:1].isupper():
                    actors.setdefault(name, parts[-2])
                elif parts[-1][:1].isupper() and self.text(k) in ("{", "(", ";"):
                    types.setdefault(name, parts[0] if len(parts) > 1 and parts[0][:1].isupper() else parts[-1])
                elif len(parts) > 1 and parts[-2][:1].isupper() and self.text(k) == "(":
                    types.setdefault(name, parts[-2])
        return actors, types

    def receiver(self, name: str, scope: Scope) -> str:
        """The actor that a variable or field refers to: as declared, else by its name; a context is the actor itself."""
        actor = self.actor_of.get(name)
        if actor is None:
            if name == "self" or "ctx" in name:
                actor = "Self"
            elif name.endswith(("_actor", "_ref")):
                for end in ("_actor_ref", "_actor", "_ref"):
                    while name.endswith(end):
                        name = name.removesuffix(end)
                actor = pascal(name)
            else:
                actor = "Unknown"
        return scope.type_name or actor if actor == "Self" else actor

    def text(self, i: int) -> str:
        return self.texts[i] if i < len(self.texts) else ""

    def join(self, a: int, b: int) -> str:
        out = ""
        for k in range(max(a, 0), min(b, len(self.texts))):
            if self.kinds[k] == DOC:
                continue
            t = self.texts[k]
            if out and (t[:1].isalnum() or t[:1] in ("_", "'", '"')) and ((c := out[-1]).isalnum() or c in "_,:>)") and not out.endswith("::"):
                out += " "
            out += t
        return out

    def past(self, i: int) -> int:
        """The place after the group that opens at ``i``."""
        if self.text(i) != "<":
            if i < self.n and self.after[i]:
                return self.after[i]
            raise KeyError(self.text(i))
        want = [">"]
        i += 1
        while i < self.n and want:
            if self.kinds[i] == OP:
                t = self.texts[i]
                if t == want[-1]:
                    want.pop()
                elif t in CLOSE:
                    want.append(CLOSE[t])
                elif t == ";":
                    return i
            i += 1
        return i

    def until(self, i: int, stops: str) -> int:
        """The next of ``stops`` outside groups."""
        while i < self.n:
            op, t = self.kinds[i] == OP, self.texts[i]
            if op and t in stops:
                return i
            i = self.past(i) if op and t in ("(", "[", "{") else i + 1
        return self.n

    def add(self, table: str, line: int, **row: object) -> None:
        self.rows[table].append({"crate": self.crate, "file": self.path, "line": line, **row})

    def qualified(self, scope: Scope, name: str) -> str:
        return "::".join((self.crate, *scope.modules, *scope.names, name))

    # -- items

    def items(self, i: int, end: int, scope: Scope) -> None:
        while i < end:
            i = max(i + 1, self.item(i, end, scope))

    def block(self, i: int, end: int, scope: Scope) -> list[tuple[str, bool]]:
        """Reads a block's items; its functions, as in ``named``."""
        before, self.named = self.named, []
        self.items(i, end, scope)
        own, self.named = self.named, before
        self.named += own  # a block in a block has them too
        return own

    def item(self, i: int, end: int, scope: Scope, in_body: bool = False) -> int:
        """Reads one item with its comments and attributes; the place after it, or ``i`` where none begins."""
        start, docs, attributes = i, [], []
        while i < end:
            t = self.texts[i]
            if self.kinds[i] == DOC:
                docs.append(re.sub(r"^///|^/\*\*|\*/$", "", t).strip())
                i += 1
            elif t == "#" and self.text(i + 1) in ("[", "!"):
                a = i + 1 + (self.text(i + 1) == "!")
                if self.text(a) != "[":
                    break
                i = self.past(a)
                attributes.append(self.join(a + 1, i - 1))
                if (m := re.match(r"([\w:]+)!\s*\((.*)\)", attributes[-1])) is not None:
                    self.macro(m[1], "attribute", m[2], self.lines[a], self.lines[a], scope)
            else:
                break
        vis = "private"
        if self.text(i) == "pub":
            vis, i = "pub", i + 1
            if self.text(i) == "(":
                b = self.past(i)
                vis, i = "pub" + self.join(i, b).replace(" ", ""), b
        flags = set()
        while self.text(i) in ("async", "unsafe", "const", "default", "extern") and (self.text(i + 1) in ("fn", "async", "unsafe", "extern", "impl", "trait") or self.kinds[i + 1] == STR):
            flags.add(self.text(i))
            i += 1 + (self.kinds[i + 1] == STR)
        word, (kind, name, line) = self.text(i), (self.kinds[i + 1], self.texts[i + 1], self.lines[i + 1]) if i < self.n else (END, "", 0)
        test = scope.test or any("test" in a for a in attributes)
        meta = {"doc": " ".join(docs) or None, "visibility": vis, "attributes": attributes, "test": test}
        if word == "fn" and kind == ID:
            return self.function(i, end, scope, flags, meta)
        if word in ("struct", "enum", "union", "trait", "type") and kind == ID and not (word == "union" and self.kinds[i] != ID):
            return self.type(i, end, scope, word, meta)
        if word == "impl":
            return self.impl(i, end, scope)
        if word == "mod" and kind == ID:
            self.rows["modules"].append({"name": name, "path": self.qualified(scope, name), "crate": self.crate, "file": self.path, "is_public": vis.startswith("pub"), "parent": "::".join((self.crate, *scope.modules))})
            if self.text(i + 2) == "{":
                stop = self.past(i + 2)
                self.items(i + 3, stop - 1, scope._replace(modules=(*scope.modules, name), test=test))
                return stop
            return i + 3
        if word == "use":
            stop = self.until(i, ";")
            self.uses(i + 1, stop, line)
            return stop + 1
        if word == "macro_rules" and name == "!":
            stop = self.past(i + 3) if self.text(i + 3) in CLOSE else i + 3
            self.macro("macro_rules", "declarative", self.text(i + 2), line, self.lines[stop - 1], scope)
            return stop
        if in_body:
            return start
        if word in ("const", "static"):
            stop = self.until(i, ";")
            self.body(i, stop, scope)
            return stop + 1
        if kind == OP and name in ("!", "::") and self.kinds[i] == ID:
            return self.body(i, self.stop_of_macro(i), scope)
        return i + 1

    def stop_of_macro(self, i: int) -> int:
        while i < self.n and self.text(i) not in ("(", "[", "{", ";"):
            i += 1
        return self.past(i) if self.text(i) in CLOSE else i + 1

    def function(self, i: int, end: int, scope: Scope, flags: set, meta: dict) -> int:
        first, line, name = i, self.lines[i], self.text(i + 1)
        i += 2
        generic = self.text(i) == "<"
        if generic:
            i = self.past(i)
        params, method = [], False
        if self.text(i) == "(":
            stop = self.past(i)
            a = i + 1
            while a < stop - 1:
                b = min(self.comma(a, stop - 1), stop - 1)
                colon = next((k for k in range(a, b) if self.text(k) == ":"), b)
                left = self.join(a, colon)
                if re.search(r"\bself$", left):
                    method = True
                elif left:
                    params.append({"name": re.sub(r"^mut ", "", left), "type": self.join(colon + 1, b)})
                a = b + 1
            i = stop
        returned = None
        if self.text(i) == "->":
            a = i + 1
            i = a
            while i < end and self.text(i) not in ("{", ";", "where"):
                i = self.past(i) if self.text(i) in ("<", "(", "[") else i + 1
            returned = self.join(a, i)
        while i < end and self.text(i) not in ("{", ";"):
            i += 1
        stop = self.past(i) if self.text(i) == "{" else i + 1
        qualified = self.qualified(scope, name)
        attributes = meta["attributes"]
        is_async = "async" in flags or any("async_trait" in a for a in attributes)
        self.named.append((name, is_async))
        self.rows["functions"].append(
            {
                "id": f"{self.crate}:{qualified}:{line}", "name": name, "qualified_name": qualified, "crate": self.crate, "module": "::".join(scope.modules), "file": self.path, "line_start": line, "line_end": self.lines[stop - 1],
                "visibility": meta["visibility"], "is_async": is_async, "is_unsafe": "unsafe" in flags, "is_generic": generic, "is_test": meta["test"], "is_trait_impl": scope.context == "TraitImpl", "is_method": method, "is_synthetic": False,
                "context": scope.context, "doc": meta["doc"], "signature": self.join(first, i), "parameters": params, "return_type": returned,
            }
        )
        if self.text(i) == "{":
            self.body(i + 1, stop - 1, scope._replace(function=qualified, function_name=name, test=meta["test"]))
        return stop

    def comma(self, i: int, end: int) -> int:
        while i < end and self.text(i) != ",":
            i = self.past(i) if self.text(i) in CLOSE else i + 1
        return i

    def type(self, i: int, end: int, scope: Scope, word: str, meta: dict) -> int:
        line, name = self.lines[i], self.text(i + 1)
        i += 2
        generic = self.text(i) == "<"
        if generic:
            i = self.past(i)
        fields, variants, methods = [], [], []
        while i < end and self.text(i) not in ("{", ";", "(", "="):
            i = self.past(i) if self.text(i) == "<" else i + 1
        opened = self.text(i)
        if opened in ("(", "{"):
            stop = self.past(i)
            if word == "trait":
                inner = scope._replace(names=(*scope.names, name), trait_name=name, context="TraitDeclaration", test=meta["test"])
                methods = [f for f, _ in self.block(i + 1, stop - 1, inner)]
            else:
                a = i + 1
                while a < stop - 1:
                    b = self.comma(a, stop - 1)
                    head = [k for k in range(a, b) if self.kinds[k] != DOC]
                    while head and self.text(head[0]) == "#":
                        past = self.past(head[0] + 1)
                        head = [k for k in head if k >= past]
                    part = re.sub(r"^pub(\([^)]*\))? ?", "", self.join(head[0], b)) if head else ""
                    if part:
                        (variants if word == "enum" else fields).append(re.split(r"[({=]", part)[0].strip() if word == "enum" else part)
                    a = b + 1
            if opened == "(":
                stop = self.until(stop, ";") + 1
        else:
            stop = self.until(i, ";") + 1
        kind = {"struct": "Struct", "enum": "Enum", "union": "Union", "trait": "Trait", "type": "TypeAlias"}[word]
        qualified = self.qualified(scope, name)
        self.rows["types"].append(
            {
                "id": f"{self.crate}:{qualified}:{line}", "name": name, "qualified_name": qualified, "crate": self.crate, "module": "::".join(scope.modules), "file": self.path, "line_start": line, "line_end": self.lines[stop - 1], "kind": kind,
                "visibility": meta["visibility"], "is_generic": generic, "is_test": meta["test"], "doc": meta["doc"], "fields": fields, "variants": variants, "methods": methods,
            }
        )
        if word == "struct" and (scope.distributed or any(re.search(r"\bdistributed_actor\b", a) for a in meta["attributes"])):
            self.actor(name, line, "Distributed", meta["test"])
        if word in ("struct", "enum") and (m := re.search(r"(Tell|Ask|Message|Query)$", name)):
            self.add("message_types", line, name=name, kind=m[1])
        return stop

    def actor(self, name: str, line: int, kind: str, test: bool) -> None:
        self.add("actors", line, id=f"{self.crate}:{name}", name=name, actor_type=kind, is_distributed=kind == "Distributed", is_test=test)

    def impl(self, i: int, end: int, scope: Scope) -> int:
        line = self.lines[i]
        i += 1
        generic = self.text(i) == "<"
        if generic:
            i = self.past(i)
        a, split = i, None
        while i < end and self.text(i) not in ("{", "where", ";"):
            if self.text(i) == "for" and split is None:
                split = i
            i = self.past(i) if self.text(i) == "<" else i + 1
        head = i
        while i < end and self.text(i) not in ("{", ";"):
            i += 1
        base = lambda s: re.sub(r"<.*", "", s).strip("&! ").split("::")[-1]
        trait_text = self.join(a, split) if split is not None else None
        type_name = base(self.join(split + 1 if split is not None else a, head))
        trait = base(trait_text) if trait_text else None
        if self.text(i) != "{":
            return i + 1
        stop = self.past(i)
        inner = scope._replace(names=(*scope.names, type_name), type_name=type_name, trait_name=trait, context="TraitImpl" if trait else "RegularImpl")
        own = self.block(i + 1, stop - 1, inner)
        self.add("impls", line, type_name=type_name, trait_name=trait, methods=[f for f, _ in own], is_generic=generic)
        assoc = {}
        for k in range(i + 1, stop - 1):
            if self.texts[k] == "type" and self.text(k + 2) == "=":
                assoc[self.text(k + 1)] = self.join(k + 3, self.until(k, ";"))
        if trait == "Actor":
            self.actor(type_name, line, "Distributed" if scope.distributed else "Local", scope.test)
            if "Msg" in assoc:
                self.add("message_types", line, name=assoc["Msg"], kind="Message")
        if trait == "Message" and (m := re.search(r"Message\s*<\s*(.+)>$", trait_text or "")):
            is_async = any(a for _, a in own)
            self.add("handles", line, actor=type_name, message_type=base(m[1]), reply_type=assoc.get("Reply", "()"), is_async=is_async)
        return stop

    def uses(self, i: int, end: int, line: int) -> None:
        def tree(a: int, b: int, prefix: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
            path = list(prefix)
            while a < b:
                t = self.text(a)
                if t == "{":
                    stop = self.past(a) - 1
                    k = a + 1
                    while k < stop:
                        c = self.comma(k, stop)
                        yield from tree(k, c, tuple(path))
                        k = c + 1
                    return
                if t == "as":
                    yield tuple(path[:-1]), path[-1], self.text(a + 1)
                    return
                if t != "::":
                    path.append(t)
                a += 1
            if path and path[-1] == "self":
                path.pop()
            if path:
                yield tuple(path[:-1]), path[-1], None

        got = list(tree(i, end, ()))
        grouped = any(self.text(k) == "{" for k in range(i, end))
        by: dict[tuple[str, ...], list[dict]] = {}
        for prefix, name, alias in got:
            by.setdefault(prefix, []).append({"name": name, "alias": alias})
        for prefix, items in by.items():
            kind = "Grouped" if grouped else "Glob" if items[0]["name"] == "*" else "Simple" if prefix else "Module"
            self.add("imports", line, module_path="::".join(prefix), import_type=kind, items=items)

    # -- bodies

    def call(self, callee: str, kind: str, line: int, scope: Scope, **more: object) -> None:
        if scope.function is not None:
            name = callee.split("::")[-1] if kind == "Method" else callee
            self.add("raw_calls", line, caller=scope.function, callee_name=name, call_type=kind, module="::".join(scope.modules), **{"is_synthetic": False, "macro_context": None, "confidence": 1.0, **more})

    def macro(self, name: str, kind: str, arguments: str, line: int, line_end: int, scope: Scope) -> None:
        self.add("macros", line, id=f"{self.path}:{line}:{name}", line_end=line_end, name=name, kind=kind, arguments=arguments, containing=scope.function)

    def body(self, i: int, end: int, scope: Scope) -> int:
        statement = True
        while i < end:
            k, t = self.kinds[i], self.texts[i]
            if k == DOC or t == "#" or statement and t in ("fn", "struct", "enum", "impl", "use", "mod", "trait", "pub", "const", "async", "unsafe", "macro_rules"):
                past = self.item(i, end, scope, in_body=True)
                if past > i:
                    i, statement = past, True
                    continue
            statement = t in (";", "{", "}")
            if k != ID or t in NO_CALL:
                i += 1
                continue
            line = self.lines[i]
            method = self.text(i - 1) == "."
            parts, a = [t], i
            if self.text(i - 1) == "::" and self.text(i - 2) == ">":
                parts = [self.ufcs(i - 2), t]
            j = i + 1
            while self.text(j) == "::":
                if self.text(j + 1) == "<":
                    j = self.past(j + 1)
                elif self.kinds[j + 1] == ID:
                    parts.append(self.text(j + 1))
                    j += 2
                else:
                    break
            after = self.text(j)
            if after == "!" and self.text(j + 1) in ("(", "[", "{"):
                stop = self.past(j + 1)
                self.invoked("::".join(parts), j + 1, stop, line, scope)
                i = j + 2 if parts[-1] not in ("paste", "distributed_actor") else stop
                continue
            if after == "(":
                if parts[0] in ("Self", "self") and len(parts) > 1 and scope.type_name:
                    parts[0] = scope.type_name
                name = "::".join(p for p in parts if p)
                kind = "Method" if method else "Associated" if "::" in name else "Direct"
                self.call(name, kind, line, scope)
                self.messages(a, j, parts, method, line, scope)
            i = j
        return end

    def ufcs(self, close: int) -> str:
        """The type of ``<Type as Trait>`` that closes at ``close``."""
        depth, i = 1, close - 1
        while i > 0 and depth:
            depth += (self.text(i) == ">") - (self.text(i) == "<")
            i -= 1
        inner = self.join(i + 2, close)
        return re.sub(r"<.*", "", inner.split(" as ")[0]).split("::")[-1]

    def invoked(self, name: str, opened: int, stop: int, line: int, scope: Scope) -> None:
        last = name.split("::")[-1]
        kind = next((k for k, names in MACRO_KINDS.items() if last in names), OTHER_MACRO)
        arguments = self.join(opened + 1, stop - 1)
        self.macro(last, kind, arguments, line, self.lines[stop - 1], scope)
        self.call(f"{last}!", "Macro", line, scope)
        if last == "distributed_actor":
            self.items(opened + 1, stop - 1, scope._replace(distributed=True))
            first = self.text(opened + 1)
            if self.text(opened + 2) == "," and self.kinds[opened + 1] == ID:
                self.actor(first, line, "Distributed", scope.test)
                for k in range(opened + 3, stop):
                    if self.kinds[k] == ID:
                        self.add("handles", line, actor=first, message_type=self.text(k), reply_type="()", is_async=True)
        if last == "paste":
            for m in re.finditer(r"\[<([^>\]]*)>\]\s*::\s*(\w+)\s*\(", arguments):
                self.call(m[2], "Associated", line, scope, is_synthetic=True, macro_context=f"[<{m[1]}>]::{m[2]}(", confidence=0.9)

    def messages(self, a: int, opened: int, parts: list[str], method: bool, line: int, scope: Scope) -> None:
        last = parts[-1]
        if method and last in SENDS:
            message = None
            if self.kinds[opened + 1] == ID:
                first = self.texts[opened + 1]
                message = first if first[:1].isupper() else self.message_of.get(first)
            k = a - 2
            if self.text(k) == ")":  # x.clone().tell(..)
                while k > 0 and self.text(k) != "(":
                    k -= 1
                k -= 3 if self.text(k - 2) == "." else 1
            receiver = self.receiver(self.text(k), scope) if self.kinds[k] == ID else "Unknown"
            self.add("sends", line, sender=scope.type_name or scope.function_name, receiver=receiver, message_type=message or "Unknown", method=SENDS[last])
        if method or len(parts) < 2:
            return
        owner, pattern = parts[-2], None
        if owner == "Actor" and last == "spawn":
            pattern = "TraitMethod"
        elif len(parts) == 3 and any(m == parts[0] and n in (None, parts[1]) and f in (None, last) for m, n, f in MODULE_SPAWNS):
            pattern = "ModuleFunction"
        elif last in SPAWNS and likely_actor(owner):
            pattern = "DirectType"
        if pattern and NO_ACTORS.isdisjoint(parts[:-1]) and not scope.test and not in_test(self.path, scope.function_name):
            child = owner if pattern == "DirectType" else self.spawned(opened)
            if child and child != "Actor":
                self.add("spawns", line, parent=scope.type_name or scope.function_name, child=child, method=last, pattern=pattern, context=spawn_context(scope.function_name))

    def spawned(self, opened: int) -> str | None:
        """The actor among the arguments: what makes one, a variable that is named as one, or a type."""
        i, stop = opened + 1, self.past(opened) - 1
        while i < stop:
            end = min(self.comma(i, stop), stop)
            if self.kinds[i] == ID:
                parts, k = [self.text(i)], i + 1
                while self.text(k) == "::" and self.kinds[k + 1] == ID:
                    parts.append(self.text(k + 1))
                    k += 2
                if len(parts) > 1 and self.text(k) == "(" and parts[-1] in MAKERS:
                    return parts[-2]
                if len(parts) == 1 and k == end:
                    if re.search(LIKELY_VARIABLE, parts[0]):
                        return pascal(parts[0])
                    if likely_actor(parts[0]):
                        return parts[0]
            i = end + 1
        return None


def read(source: str, path: str, crate: str) -> Iterator[dict[str, list[dict]]]:
    """The rows by table, again and again after each top-level item; whoever takes them may clear them. Of a file that cannot be read to its end, those up to there and a row of ``errors``."""
    r, i, scope = Reader(source, path, crate), 0, Scope(modules=module_prefix(path))
    try:
        while i < r.n:
            i = max(i + 1, r.item(i, r.n, scope))
            r.named.clear()
            yield r.rows
    except (RecursionError, IndexError, KeyError, ValueError) as e:
        r.rows["errors"] = [{"file": path, "crate": crate, "message": f"{type(e).__name__}: {e}"[:500]}]
    yield r.rows


def parse(source: str, path: str, crate: str) -> dict[str, list[dict]]:
    """The symbols of one file."""
    *_, rows = read(source, path, crate)
    return rows


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, crate, text) of the ``.rs`` files below ``root``; the crate is the folder above ``src``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(root)
    return raw.select("path", F.regexp_extract("path", r"([^/]+)/(?:src|tests|examples|benches)/", 1).alias("crate"), F.decode("content", "UTF-8").alias("text"))


#: Rows that a scan gathers before it hands them on.
ROWS = 2_000


def scan(sources: DataFrame, *only: str) -> DataFrame:
    """(table, row: JSON) of all symbols in (path, crate, text) rows; of the tables ``only``, where some are named."""
    schema = pa.schema([("table", pa.string()), ("row", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                path, crate, text = (batch.column(c)[k].as_py() or "" for c in range(3))
                for found in read(text, path, crate):
                    for name, got in found.items():
                        if got:
                            if not only or name in only:
                                names += [name] * len(got)
                                rows += map(json.dumps, got)
                            got.clear()
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pydict({"table": names, "row": rows}, schema=schema)
                        names, rows = [], []
        if rows:
            yield pa.RecordBatch.from_pydict({"table": names, "row": rows}, schema=schema)

    return sources.select("path", "crate", "text").mapInArrow(run, "table string, row string")


def tables(scanned: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of a scan. Write the scan first (or cache it) when several are used: each reads it anew."""
    names = ("functions", "types", "modules", "imports", "impls", "raw_calls", "macros", "actors", "spawns", "message_types", "handles", "sends", "errors")
    return {n: scanned.filter(F.col("table") == n).select(F.from_json("row", SCHEMAS[n]).alias("r")).select("r.*") for n in names}
