"""Relations and write couplings declared in a tree of Rails models."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from seamline.functions.inflect import IRREGULAR
from seamline.sources.models import Found, Source, files, frames, resolve

# Tables of models that come with common libraries.
LIBRARY_TABLES = {
    "Doorkeeper::AccessGrant": "oauth_access_grants",
    "Doorkeeper::AccessToken": "oauth_access_tokens",
    "Doorkeeper::Application": "oauth_applications",
    "ActiveStorage::Attachment": "active_storage_attachments",
    "ActiveStorage::Blob": "active_storage_blobs",
    "ActiveStorage::VariantRecord": "active_storage_variant_records",
    "ActionText::RichText": "action_text_rich_texts",
    "ActionMailbox::InboundEmail": "action_mailbox_inbound_emails",
}
BASES = ("ApplicationRecord", "ActiveRecord::Base")
KINDS = ("belongs_to", "has_many", "has_one")
CALLBACK = re.compile(r"\s*(?:before|after|around)_(?:save|create|update|destroy|commit|validation|touch)\w*\b")
BULK = r"(?:update_all|delete_all|destroy_all|insert_all|upsert_all)"
OPTION = re.compile(r"""(\w+):\s*(?:["']([^"']*)["']|:(\w+)|([\w:]+))""")


def singular(word: str) -> str:
    back = {p: s for s, p in IRREGULAR.items()}
    if word in back:
        return back[word]
    if re.search(".ies$", word):
        return word[:-3] + "y"
    if re.search("(ch|sh|x|z|s)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def plural(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if re.search("[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search("(s|x|z|ch|sh)$", word) else "s")


def underscored(name: str) -> str:
    return re.sub("(?<=.)([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    return "::".join("".join(p[:1].upper() + p[1:] for p in part.split("_")) for part in name.split("/"))


def on_last(change, name: str) -> str:
    head, _, last = name.rpartition("_")
    return f"{head}_{change(last)}" if head else change(last)


@dataclass
class Association:
    kind: str
    name: str
    options: dict[str, str]
    origin: str


@dataclass
class Unit:
    """A class or a module."""

    name: str
    is_class: bool
    origin: str
    base: str = ""
    table: str = ""
    prefix: str | None = None
    abstract: bool = False
    callbacks: bool = False
    includes: list[str] = field(default_factory=list)
    associations: list[Association] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def logical_lines(text: str) -> list[tuple[int, str]]:
    """(first line, text) without comments; a line that ends with a comma or an open bracket goes on in the next."""
    out, held, start = [], "", 0
    for no, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#(?!\{).*$", "", line).rstrip()
        if held:
            held += " " + line.strip()
        elif line:
            held, start = line, no
        if held and not held.endswith((",", "(")):
            out.append((start, held))
            held = ""
    return out + ([(start, held)] if held else [])


def parse(source: Source) -> list[Unit]:
    """The file's classes and modules; nesting follows the indentation."""
    units: list[Unit] = []
    open_: list[tuple[int, Unit | None, dict[str, str]]] = []  # indentation, class or module, options that hold inside
    awaits_prefix = False
    for no, line in logical_lines(source.text):
        depth, code = len(line) - len(line.lstrip()), line.strip()
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        here = next((u for _, u, _ in reversed(open_) if u), None)
        origin = f"{source.path}:{no}"
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([\w:]+))?", code):
            unit = Unit(f"{here.name}::{m[2]}" if here else m[2], m[1] == "class", origin, m[3] or "", text=[line])
            units.append(unit)
            open_.append((depth, unit, {}))
        elif here is None:
            continue
        else:
            here.text.append(line)
            if awaits_prefix and (m := re.match(r"""["']([^"']*)["']$""", code)):
                here.prefix = m[1]
            awaits_prefix = False
            if m := re.match(r"(?:def\s+)?self\.table_name_prefix\s*=?\s*(?:[\"']([^\"']*)[\"'])?", code):
                here.prefix, awaits_prefix = (m[1], False) if m[1] is not None else (here.prefix, True)
            elif m := re.match(r"""self\.table_name\s*=\s*["':]([\w.]+)""", code):
                here.table = m[1]
            elif re.match(r"self\.abstract_class\s*=\s*true|primary_abstract_class\b", code):
                here.abstract = True
            elif m := re.match(r"include\s+(.+)", code):
                here.includes += re.findall(r"[A-Z][\w:]*", m[1])
            elif m := re.match(r"with_options\s+(.*?)\s*do\b", code):
                open_.append((depth, None, options(m[1])))
            elif m := re.match(r"(?:\w+\.)?(" + "|".join(KINDS) + r")[\s(]+:(\w+)(.*)", code):
                inherited: dict[str, str] = {}
                for _, _, held in open_:
                    inherited |= held
                here.associations.append(Association(m[1], m[2], inherited | options(m[3]), origin))
            elif CALLBACK.match(code):
                here.callbacks = True
    return units


def options(text: str) -> dict[str, str]:
    return {k: next((v for v in rest if v), "") for k, *rest in OPTION.findall(text)}


class Tree:
    def __init__(self, sources: list[Source]) -> None:
        self.units: dict[str, Unit] = {}
        self.file_of: dict[str, Source] = {}
        for source in sources:
            for unit in parse(source):
                self.units.setdefault(unit.name, unit)
                self.file_of.setdefault(unit.name, source)
        for unit in self.units.values():  # what a concern declares holds in what includes it
            for name in unit.includes if unit.is_class else []:
                concern = self.units.get(self.lookup(unit.name, name) or "")
                if concern and not concern.is_class:
                    unit.associations += concern.associations
                    unit.callbacks |= concern.callbacks
                    unit.text += concern.text
        self.models = {n: u for n, u in self.units.items() if u.is_class and not u.abstract and self.is_model(n)}
        self.named: dict[str, str] = {}
        self.back: dict[str, tuple[dict[str, str], dict[str, set[str]]]] = {}
        self.first: dict[int, str] = {}  # the first model of each file
        for name in self.models:
            self.first.setdefault(id(self.file_of[name]), name)

    @cached_property
    def tables(self) -> set[str]:
        """The tables of all models."""
        return {self.table(n) for n in self.models}

    def lookup(self, scope: str, name: str) -> str | None:
        """The unit that a constant means in scope: the innermost enclosing namespace that has it."""
        if name.startswith("::"):
            return name[2:] if name[2:] in self.units else None
        parts = scope.split("::")
        return next((c for k in range(len(parts), -1, -1) if (c := "::".join([*parts[:k], name])) in self.units and c != scope or (c == scope and name == scope)), None)

    def is_model(self, name: str) -> bool:
        seen = set()
        while name not in seen:
            seen.add(name)
            base = self.units[name].base
            if base.removeprefix("::") in BASES:
                return True
            above = self.lookup(name, base) if base else None
            if above is None:
                return False
            name = above
        return False

    def model(self, scope: str, name: str) -> str | None:
        """The model or library model that a name means in scope."""
        if (found := self.lookup(scope, name)) in self.models:
            return found
        return name.removeprefix("::") if name.removeprefix("::") in LIBRARY_TABLES else None

    def table(self, name: str) -> str:
        """The table of a model, looked for once."""
        if name not in self.named:
            self.named[name] = self._table(name)
        return self.named[name]

    def _table(self, name: str, seen: tuple[str, ...] = ()) -> str:
        """The stated name, or that of the parent model, or the plural after the namespace's prefix or the enclosing model's singular."""
        if name in LIBRARY_TABLES:
            return LIBRARY_TABLES[name]
        unit = self.models[name]
        if unit.table:
            return unit.table
        parent = self.lookup(name, unit.base) if unit.base else None
        if parent in self.models and parent not in seen:
            return self._table(parent, (*seen, name))
        outer, _, last = name.rpartition("::")
        plain = on_last(plural, underscored(last))
        while outer:
            if outer in self.models:
                return f"{on_last(singular, self._table(outer, (*seen, name)))}_{plain}"
            if outer in self.units and self.units[outer].prefix is not None:
                return f"{self.units[outer].prefix}{plain}"
            outer = outer.rpartition("::")[0]
        return plain

    def target(self, scope: str, a: Association) -> str | None:
        guess = camel(a.name if a.kind != "has_many" else on_last(singular, a.name))
        return self.model(scope, a.options.get("class_name") or guess)

    def belongs(self, child: str) -> tuple[dict[str, str], dict[str, set[str]]]:
        """The columns of what a model belongs to, by name and by the model meant; read once."""
        if child not in self.back:
            back = [b for b in (self.models[child].associations if child in self.models else []) if b.kind == "belongs_to"]
            column, stated = {b.name: b.options.get("foreign_key", f"{b.name}_id") for b in back}, {}
            for b in back:
                if "polymorphic" not in b.options and (owner := self.target(child, b)):
                    stated.setdefault(owner, set()).add(column[b.name])
            self.back[child] = column, stated
        return self.back[child]


def _back_column(tree: Tree, owner: str, a: Association, child: str) -> str | None:
    """The child's column for a has_many or has_one of owner; None where only a guess contradicts what the child declares."""
    said = a.options
    if "foreign_key" in said:
        return said["foreign_key"]
    if "as" in said:
        return f"{said['as']}_id"
    column, by_owner = tree.belongs(child)
    if "inverse_of" in said:
        return column.get(said["inverse_of"], f"{said['inverse_of']}_id")
    guess = f"{underscored(owner.rpartition('::')[2])}_id"
    stated = by_owner.get(owner, set())
    return guess if not stated or guess in stated else None


def read(sources: list[Source]) -> Found:
    """Tables, relations, suspects and notes of a tree's model files."""
    tree, found = Tree(sources), Found()
    holders: dict[str, list[str]] = {}
    for name, unit in tree.models.items():
        for a in unit.associations:
            if "as" in a.options and a.kind != "belongs_to":
                holders.setdefault(a.options["as"] + "\0" + (tree.target(name, a) or ""), []).append(name)
    for name, unit in tree.models.items():
        own, declared = tree.table(name), {name}
        found.table(own, name, unit.origin)
        for a in unit.associations:
            if "through" in a.options:
                continue
            if a.kind == "belongs_to" and a.options.get("polymorphic") == "true":
                partners = holders.get(f"{a.name}\0{name}", [])
            else:
                partners = [t] if (t := tree.target(name, a)) else []
                if not partners:
                    found.note(f"no model for {name}.{a.name}: not made a relation")
            for other in partners:
                declared.add(other)
                there = tree.table(other)
                if a.kind == "belongs_to":
                    child, parent, of, column = own, there, name, a.options.get("foreign_key", f"{a.name}_id")
                    nullable, cascade = "true" if a.options.get("optional") == "true" else "false", False
                else:
                    child, parent, of, column = there, own, other, _back_column(tree, name, a, other)
                    nullable, cascade = "unknown", a.options.get("dependent", "") in ("destroy", "delete_all", "destroy_async", "delete")
                many = "(polymorphic)" if a.options.get("polymorphic") == "true" or "as" in a.options else ""
                if column:
                    found.relation(child, [column], parent, f"ar:{underscored(of).replace('::_', '/')}.{column}{many}", a.origin, nullable, cascade)
        _suspects(tree, found, name, declared)
    return found


def _suspects(tree: Tree, found: Found, name: str, declared: set[str]) -> None:
    unit, own = tree.models[name], tree.table(name)
    text = "\n".join(unit.text)
    first = text.split("\n", 1)[0]
    body = re.sub(r"""(["'])(?:(?!\1)[^\\\n]|\\.)*\1""", '""', text.replace(first, re.sub(r"^\s*class\s+[\w:]+", "", first), 1))
    bulk = {tree.model(name, c) for c in re.findall(r"\b([A-Z][\w:]*)\b(?:\.\w+(?:\([^()\n]*\))?)*?\." + BULK + r"\b", body)}
    for other in sorted(bulk - {None, name}):
        found.suspect(own, tree.table(other), True, "bulk write")
    for other in sorted({tree.model(name, c) for c in re.findall(r"(?<![\w:])[A-Z][\w:]*\w", body)} - declared - {None}):
        found.suspect(own, tree.table(other), unit.callbacks, "mention")
    joined = re.findall(r"\.(?:joins|includes|eager_load|preload)\(\s*:(\w+)", body)
    for other in sorted({tree.model(name, camel(on_last(singular, j))) for j in joined} - declared - {None}):
        found.suspect(own, tree.table(other), False, "join")
    if tree.first[id(tree.file_of[name])] == name:
        for tables, strong, why in ((tree.file_of[name].writes, True, "raw write"), (tree.file_of[name].reads, False, "raw read")):
            for other in tables:
                if other in tree.tables and other != own:
                    found.suspect(own, other, strong, why)


def rails(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """tables, relations, suspects and notes of the models under root/app/models. No model files give empty frames."""
    return frames(resolve(files(spark, root, r"(^|/)app/models/.*\.rb$"), read), "rails")
