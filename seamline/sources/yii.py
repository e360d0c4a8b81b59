"""Relations and write couplings declared in a tree of Yii 1 models."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from seamline.sources.models import Found, Source, files, frames, resolve

CLASS = re.compile(r"(?:^[ \t]*|<\?php\s+|[;}]\s*)(abstract\s+|final\s+)*class\s+(\w+)(?:\s+extends\s+\\?([\w\\]+))?[^{]*\{", re.M | re.I)
METHOD = re.compile(r"function\s+(\w+)\s*\([^)]*\)[^{;]*\{", re.I)
RELATION = re.compile(r"""["'](\w+)["']\s*\]?\s*=>?\s*(?:array\s*\(|\[)\s*(?:self|static|CActiveRecord)::(BELONGS_TO|HAS_ONE|HAS_MANY|MANY_MANY|STAT)\s*,""")
ANY_RELATION = re.compile(r"(?:self|static|CActiveRecord)::(?:BELONGS_TO|HAS_ONE|HAS_MANY|MANY_MANY|STAT)\b")
PAIRS = {"(": ")", "[": "]", "{": "}"}
CALLBACKS = re.compile(r"(?:before|after)(?:save|delete|validate)$", re.I)
WRITES = r"(?:updateAll|deleteAll|updateByPk|deleteByPk|updateCounters|deleteAllByAttributes|updateAllByAttributes)"


def without_comments(text: str) -> str:
    """The text with comments blanked, line breaks kept; comment marks in strings are no comments."""
    token = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|/\*.*?\*/|(?://|\#)[^\n]*""", re.S)
    return token.sub(lambda m: m[0] if m[0][0] in "'\"" else re.sub(r"[^\n]", " ", m[0]), text)


def enclosed(text: str, at: int) -> str:
    """What stands between the bracket at position at and the one that closes it; strings are skipped."""
    depth = 0
    for m in re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[][(){}]""", re.S).finditer(text, at):
        depth += 1 if m[0] in PAIRS else -1 if m[0] in PAIRS.values() else 0
        if depth == 0:
            return text[at + 1 : m.start()]
    return text[at + 1 :]


def pieces(text: str, sign: str = ",") -> list[str]:
    """text cut at sign where it stands outside strings and brackets."""
    out, depth, start = [], 0, 0
    for m in re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[][(){}]|""" + re.escape(sign), re.S).finditer(text):
        depth += 1 if m[0] in PAIRS else -1 if m[0] in PAIRS.values() else 0
        if m[0] == sign and not depth:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [p for p in [*out, text[start:].strip()] if p]


def literal(text: str) -> str | None:
    m = re.fullmatch(r"""(["'])((?:(?!\1)[^\\]|\\.)*)\1""", text.strip(), re.S)
    return m[2].replace("\\\\", "\\") if m else None


@dataclass
class Class:
    name: str
    base: str
    origin: str
    body: str
    path: str
    line: int
    methods: dict[str, tuple[str, int]] = field(default_factory=dict)  # lower-case name: body, first line


def parse(source: Source) -> list[Class]:
    text, out = without_comments(source.text), []
    for m in CLASS.finditer(text):
        body, line = enclosed(text, m.end() - 1), text.count("\n", 0, m.end()) + 1
        unit = Class(m[2], (m[3] or "").rpartition("\\")[2], f"{source.path}:{line}", body, source.path, line)
        for f in METHOD.finditer(body):
            unit.methods.setdefault(f[1].lower(), (enclosed(body, f.end() - 1), line + body.count("\n", 0, f.end())))
        out.append(unit)
    return out


class Tree:
    """The classes of a tree by lower-case name, as PHP does not tell case apart there; of classes of one name the first by path."""

    def __init__(self, sources: list[Source], prefix: str) -> None:
        self.prefix, self.classes = prefix, {}
        self.raw = {s.path: s.text for s in sources}
        for s in sources:
            for c in parse(s):
                self.classes.setdefault(c.name.lower(), c)
        self.parents = {c.base.lower() for c in self.classes.values()}
        self.tables: dict[str, str] = {}
        self.notes: list[str] = []
        for key, c in self.classes.items():
            if self.is_record(key):
                name = self.name(key)
                if name:
                    self.tables[key] = name
                elif key not in self.parents:
                    self.notes.append(f"the table of {c.name} is not known before it runs")
            elif self.find(key, "tablename"):
                self.notes.append(f"{c.name} has a table name, but its parent {c.base} was not read")
        self.known = {t.lower(): t for t in self.tables.values()}

    def chain(self, key: str) -> list[Class]:
        out: list[Class] = []
        while key in self.classes and self.classes[key] not in out:
            out.append(self.classes[key])
            key = out[-1].base.lower()
        return out

    def is_record(self, key: str) -> bool:
        up = self.chain(key)
        return bool(up) and up[-1].base.lower().endswith("activerecord")

    def find(self, key: str, method: str) -> tuple[Class, str, int] | None:
        """The class in the line of parents that has the method, its body and line."""
        return next(((c, *c.methods[method]) for c in self.chain(key) if method in c.methods), None)

    def name(self, key: str) -> str | None:
        """The table of a record class: what tableName returns, * for what is known at run time alone; without the method the class name, unless others extend it."""
        at = self.find(key, "tablename")
        if at is None:
            own = self.classes[key]
            return None if key in self.parents or re.search(rf"abstract\s+class\s+{own.name}\b", self.raw[own.path], re.I) else own.name
        text = self.returned(key, at[1], 3)
        if text is None or not text.strip("*_"):
            return None
        return self.bare(text)

    def bare(self, text: str) -> str:
        """Names in {{ }} have the prefix put before them."""
        m = re.fullmatch(r"\{\{(.*)\}\}", text.strip())
        return self.prefix + m[1] if m else text.strip()

    def returned(self, key: str, body: str, depth: int) -> str | None:
        """The string that a method's body returns; getters of this or of a typed property or relation are followed depth times."""
        m = re.search(r"\breturn\s+(.*?);", body, re.S)
        if not m or depth == 0:
            return None
        if (chased := re.fullmatch(r"\$this->(?:(\w+)->)?(\w+)(\(\))?", m[1].strip())) is not None:
            owner = self.partner(key, chased[1]) if chased[1] else key
            getter = chased[2].lower() if chased[3] else "get" + chased[2].lower()
            at = self.find(owner, getter) if owner else None
            return self.returned(owner, at[1], depth - 1) if at else None
        parts = [literal(p) for p in pieces(m[1], ".")]
        return None if all(p is None for p in parts) else "".join("*" if p is None else re.sub(r"\{?\$[\w>-]+\}?(?!\})", "*", p) for p in parts)

    def partner(self, key: str, member: str) -> str | None:
        """The class of a property with a type or a @var comment, or of a relation."""
        for c in self.chain(key):
            if m := re.search(rf"@var\s+\\?([\w\\]+)[^\n]*\n?\s*(?:\*/)?\s*(?:public|protected|private|var)\s+\${member}\b", self.raw[c.path]) or re.search(rf"@var\s+\\?([\w\\]+)\s+\${member}\b", self.raw[c.path]):
                return m[1].rpartition("\\")[2].lower()
        return next((r[2] for r in self.declared(key)[0] if r[0] == member), None)

    def declared(self, key: str) -> tuple[list[tuple[str, str, str, list[str], str]], int]:
        """(name, kind, lower-case class, other arguments, origin) of the relations of a class and those it takes over, and how many cannot be read."""
        out, unread = [], 0
        for c in self.chain(key):
            if "relations" not in c.methods:
                continue
            body, line = c.methods["relations"]
            found = list(RELATION.finditer(body))
            unread += len(ANY_RELATION.findall(body)) - len(found)
            at = 0
            for m in found:
                line += body.count("\n", at, m.start())
                at = m.start()
                args = pieces(enclosed(body, max(body.rfind("(", at, m.start(2)), body.rfind("[", at, m.start(2)))))[1:]
                cls = re.fullmatch(r"\\?([\w\\]+)::class", args[0]) if args else None
                said = cls[1] if cls else literal(args[0]) if args else None
                if said:
                    out.append((m[1], m[2], said.rpartition("\\")[2].lower(), args[1:], f"{c.path}:{line}"))
                else:
                    unread += 1
            if not re.search(r"parent::relations\s*\(", body):
                break
        return out, unread

    def by_name(self, raw: str) -> str | None:
        """The known table that raw SQL means, with the prefix or without."""
        return self.known.get((self.prefix + raw).lower()) or self.known.get(raw.lower())


def key_columns(kind: str, name: str, args: list[str]) -> list[str] | None:
    """The key's columns on the child's side: a list of names, own columns to the partner's, or those that the on clause compares."""
    if args and (m := re.match(r"(?:array\s*\(|\[)", args[0])):
        items = [literal(p.split("=>")[0]) for p in pieces(enclosed(args[0], m.end() - 1))]
        return items if items and all(items) else None
    said = literal(args[0]) if args else None
    if said:
        return [c.strip() for c in said.split(",")]
    clause = next((m[1] for a in args[1:] if (m := re.match(r"""["']on["']\s*=>\s*["'](.*)["']$""", a, re.S))), "")
    sides = re.search(r"([$\w]+)\.(\w+)\s*=\s*([$\w]+)\.(\w+)", clause)
    if not sides:
        return None
    ends = {sides[1]: sides[2], sides[3]: sides[4]}
    mine = next((c for t, c in ends.items() if (t != name) == (kind == "BELONGS_TO")), None)
    return [mine] if mine else None


def read(sources: list[Source]) -> Found:
    """Tables, relations, suspects and notes of a tree's model files; its configuration gives the prefix of names in {{ }}."""
    config = "\n".join(s.text for s in sources if "/config/" in f"/{s.path}")
    prefix = re.search(r"""["']tablePrefix["']\s*=>\s*["']([^"']*)["']""", without_comments(config))
    models = [s for s in sources if "/models/" in f"/{s.path}"]
    tree, found = Tree(models, prefix[1] if prefix else ""), Found()
    for key, table in tree.tables.items():
        found.table(table, tree.classes[key].name, tree.classes[key].origin)
    for note in tree.notes:
        found.note(note)
    for key, own in tree.tables.items():
        mine = tree.classes[key]
        relations, unread = tree.declared(key)
        if unread:
            found.note(f"{mine.name}: {unread} relations are made at run time")
        declared = {key}
        for name, kind, other, args, origin in relations:
            there = tree.tables.get(other)
            declared.add(other)
            label = f"yii:{mine.name}.{name}"
            if there is None:
                found.note(f"no model for {mine.name}.{name}: not made a relation")
            if kind == "MANY_MANY":
                m = re.match(r"\s*([\w{}$]+)\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", (literal(args[0]) or "") if args else "")
                if m:
                    found.relation(tree.bare(m[1]), [m[2]], own, label, origin)
                    if there:
                        found.relation(tree.bare(m[1]), [m[3]], there, label, origin)
            elif there:
                columns = key_columns(kind, name, args)
                if not columns:
                    found.note(f"{mine.name}.{name}: its columns cannot be read")
                elif kind == "BELONGS_TO":
                    found.relation(own, columns, there, label, origin)
                elif not any(re.match(r"""["']through["']""", a) for a in args):
                    found.relation(there, columns, own, label, origin)
        _suspects(tree, found, key, declared, relations)
    raw = {s.path: s for s in models}
    joins = {t.lower(): t for t in sorted({r["a"] for r in found.rows if r["kind"] == "relation"}, reverse=True)}
    first: dict[str, str] = {}  # the table of the first record class of each file
    for key, own in tree.tables.items():
        first.setdefault(tree.classes[key].path, own)
    for path, own in sorted(first.items()):
        for names, strong, why in ((raw[path].writes, True, "raw write"), (raw[path].reads, False, "raw read")):
            for n in names:
                other = tree.by_name(n) or joins.get(n.lower()) or joins.get((tree.prefix + n).lower())
                if other and other != own:
                    found.suspect(own, other, strong, why)
    return found


def _suspects(tree: Tree, found: Found, key: str, declared: set[str], relations: list) -> None:
    unit, own = tree.classes[key], tree.tables[key]
    others = lambda pattern, text: sorted({c for m in re.findall(pattern, text) if (c := m.lower()) in tree.tables and c != key})
    in_delete = "\n".join(body for name, (body, _) in unit.methods.items() if name in ("beforedelete", "afterdelete"))
    calls = any(CALLBACKS.match(name) for name in unit.methods)
    for other in others(r"\b(\w+)::model\(\)->(?:delete|findAll|find)\w*\(", in_delete) if re.search(r"->delete", in_delete) else []:
        found.suspect(own, tree.tables[other], True, "manual cascade")
    for other in others(rf"\b(\w+)::model\(\)->{WRITES}\b", "\n".join(b for n, (b, _) in unit.methods.items() if n not in ("beforedelete", "afterdelete"))):
        found.suspect(own, tree.tables[other], True, "bulk write")
    for other in sorted({*others(r"\b(\w+)::model\(\)", unit.body), *others(r"\bnew\s+(\w+)", unit.body)}):
        if other not in declared:
            found.suspect(own, tree.tables[other], calls, "mention")
    by_relation = {r[0]: r[2] for r in relations}
    withs = " ".join(re.findall(r"""(?:["']with["']\s*=>\s*|->with\()\s*((?:array\s*\(|\[)?[^)\]]*)""", unit.body))
    for name in sorted(set(re.findall(r"""["'](\w+)["']""", withs)) & by_relation.keys()):
        if by_relation[name] in tree.tables:
            found.suspect(own, tree.tables[by_relation[name]], False, "with")


def yii1(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """tables, relations, suspects and notes of the models under root/protected, tests left out. No model files give empty frames."""
    found = files(spark, root, r"^protected/(?!(.*/)?tests?/)((.*/)?models/[^/]*|config/[^/]*)\.php$")
    return frames(resolve(found, read), "yii1")
