"""Sessions: programs of statements over one corpus. Named sets stay unexecuted DataFrames; commands build on them."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame

from ..operators import commands
from ..operators.commands import Settings
from ..sources.corpus import Corpus
from .language import Command, Field, QueryError, Statement, parse
from .lower import Lowering, Matches, Options


class Session:
    def __init__(self, corpus: Corpus, settings: Settings | None = None, options: Options | None = None, strict: bool = False):
        self.corpus, self.settings, self.options, self.strict = corpus, settings or Settings(), options or Options(), strict
        self.named: dict[str, Matches] = {}

    @property
    def lowering(self) -> Lowering:
        return Lowering(self.corpus, self.options, self.named)

    def query(self, text: str) -> Matches:
        """The matches of one query."""
        self.run(text)
        return self.named["Last"]

    def run(self, program: str) -> DataFrame | None:
        """Runs a program; returns the last statement's result: a command's table, or a query's concordance rows (lo, hi)."""
        out = None
        for s in parse(program, self.strict, self.options.max_gap):
            out = self.statement(s) if isinstance(s, Statement) else self.command(s)
        return out

    def statement(self, s: Statement) -> DataFrame:
        m = self.lowering.query(s.query)
        self.named["Last"] = m
        if s.name:
            self.named[s.name] = m
        return m.df.select(*[c for c in m.df.columns if not c.startswith("_")])

    def of(self, names: list[str]) -> Matches:
        name = names[0] if names else "Last"
        if name not in self.named:
            raise QueryError(f"no query is named {name}")
        return self.named[name]

    def attr(self, fields: list[Field]) -> str:
        name = fields[0].attr if fields else "lemma"
        return name if name in self.corpus.attrs else "form"

    def command(self, c: Command) -> DataFrame | None:
        low, st = self.lowering, self.settings
        if c.verb in ("count", "group"):
            return commands.count(low, self.of(c.names), c.fields, st)
        if c.verb == "freq":
            if len(c.names) > 1:
                return commands.freq_compare(low, {n: self.of([n]) for n in c.names}, c.fields, st)
            return commands.freq(low, self.of(c.names), c.fields, st)
        if c.verb == "sort":
            return commands.sort(low, self.of(c.names), c.fields)
        if c.verb == "stats":
            return commands.stats(low, self.of([]), c.args["metrics"], c.fields)
        if c.verb == "coll":
            return commands.coll(low, self.of(c.names), self.attr(c.fields), st, c.args.get("on", ""))
        if c.verb == "dcoll":
            relations, names = list(c.args["relations"]), list(c.names)
            if names and names[0] not in self.named:  # not a set: a relation
                relations.insert(0, names.pop(0))
            return commands.dcoll(low, self.of(names), relations, self.attr(c.fields), st, c.args.get("on", ""))
        if c.verb == "keyness":
            versus = c.args.get("versus")
            return commands.keyness(low, self.of(c.names), self.of([versus]) if versus else None, self.attr(c.fields), st)
        if c.verb == "tabulate":
            return commands.tabulate(low, self.of(c.names), c.fields, c.args.get("offset", 0), c.args.get("limit", 1000))
        if c.verb == "size":
            return commands.size(self.of(c.names)) if c.names or "Last" in self.named else commands.show_info(low)
        if c.verb == "raw":
            return commands.raw(low, self.of(c.names))
        if c.verb == "cat":
            return commands.concordance(low, self.of(c.names), st)
        if c.verb == "show":
            return self.show(c.args["what"], c.args.get("name", ""))
        if c.verb == "set":
            return self.set(c.args["name"], c.args["value"])
        return self.drop(c.args["name"])

    def show(self, what: str, name: str) -> DataFrame:
        low = self.lowering
        if what == "values":
            return commands.show_values(low, name, self.settings)
        if what == "regions":
            return commands.show_regions(low, name)
        if what == "attributes":
            return commands.show_attributes(low)
        if what == "info":
            return commands.show_info(low)
        rows = {"named": [(n, str(sorted(m.labels))) for n, m in self.named.items()], "settings": [(k, json.dumps(v)) for k, v in dataclasses.asdict(self.settings).items()]}
        if what not in rows:
            raise QueryError(f"can't show {what}")
        return self.corpus.spark.createDataFrame(rows[what], "name string, value string")

    def set(self, name: str, value: str) -> None:
        if name in ("binding", "empty_alignment", "max_gap"):
            setattr(self.options, name, {"binding": str, "empty_alignment": lambda v: v in ("true", "1", "on"), "max_gap": int}[name](value))
            return
        if name == "strict":
            self.strict = value in ("true", "1", "on")
            return
        if not hasattr(self.settings, name):
            raise QueryError(f"unknown setting {name}")
        old = getattr(self.settings, name)
        setattr(self.settings, name, value.split(",") if isinstance(old, list) else value in ("true", "1", "on") if isinstance(old, bool) else int(value))

    def drop(self, name: str) -> None:
        if name == "all":
            self.named.clear()
        else:
            self.named.pop(name, None)
