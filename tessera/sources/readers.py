"""Readers of annotated text: CoNLL-U, vertical, JSONL events (both versions), bracketed trees, CWB binaries.

A file is parsed in one task (files are the unit of parallelism, as their positions depend on what comes before
in them). The parsers are plain generators of events; ``assemble`` turns the events of all files into a corpus.
Positions are ``file number * 2^32 + place``: files keep their order by path, and nothing is summed over the corpus.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .build import with_parents, with_tree
from .corpus import MISSING, Corpus

FILE_BITS = 32
EVENTS = "kind string, name string, place long, stop long, sent long, head long, attrs map<string,string>, spans array<struct<s:long,e:long>>"
MISC = ("tuid", "Translit", "Vform", "LTranslt", "Root", "CorrectForm", "Gloss")
TEXT_ATTRS = ("id", "genre", "lang", "langcode", "treebank", "century")


class Events:
    """Collects a file's events: tokens of the open sentence, then regions and groups."""

    def __init__(self):
        self.rows, self.n, self.sent, self.open = [], 0, 0, []
        self.buffer, self.meta = [], {}

    def token(self, attrs, head=None, key=None, head_key=None):
        self.buffer.append((attrs, head, key, head_key))

    @property
    def size(self):
        return self.n + len(self.buffer)

    def end_sentence(self, attrs=None, numbers=None):
        """numbers: sentence-local numbers to places; heads are 1-based numbers, 0 the root."""
        if not self.buffer:
            return
        first = self.n
        keys = {k: first + i for i, (_, _, k, _) in enumerate(self.buffer) if k}
        for i, (a, head, _, head_key) in enumerate(self.buffer):
            at = keys.get(head_key) if head_key else None
            if at is None and head is not None and 0 < head <= len(self.buffer):
                at = first + head - 1
            self.rows.append(("token", "", first + i, None, self.sent, at, a, None))
        self.n += len(self.buffer)
        self.buffer = []
        self.region("s", first, self.n - 1, attrs or {})
        self.sent += 1

    def region(self, name, start, stop, attrs):
        self.rows.append(("region", name, start, stop, None, None, dict(attrs), None))

    def group(self, name, spans, attrs):
        self.rows.append(("group", name, spans[0][0], spans[-1][1], None, None, dict(attrs), [{"s": a, "e": b} for a, b in spans]))

    def begin(self, name, attrs=None, key=None):
        self.open.append([name, self.size, dict(attrs or {}), key])

    def end(self, name, key=None):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name and (key is None or self.open[i][3] == key):
                _, start, attrs, _ = self.open.pop(i)
                self.region(name, start, self.size - 1, attrs)
                return

    def close(self):
        for name, *_ in list(reversed(self.open)):
            self.end(name)


def features(value: str, split: bool) -> dict:
    if not split or value in ("", MISSING):
        return {"feats": value} if value else {}
    return {f"feats#{k}": v for k, _, v in (p.partition("=") for p in value.split("|")) if v}


def sentence_translation(key: str) -> bool:
    m = re.fullmatch(r"text_([a-z]{2,3})", key)
    return bool(m) and m[1] not in ("src", "ref", "dom", "uri", "url", "num", "cat", "new", "old")


def parse_conllu(text: str, split_feats: bool = False) -> list:
    e, sent, words, contractions, numbers = Events(), {}, 0, [], {}
    e.text = None

    def end_sentence():
        nonlocal sent, contractions, numbers
        if e.buffer:
            for a, b, form in contractions:
                if a in numbers and b in numbers:
                    e.region("contr", numbers[a], numbers[b], {"form": form})
            e.end_sentence(sent)
        sent, contractions, numbers = {}, [], {}

    def close(name):
        if any(o[0] == name for o in e.open):
            e.end(name)

    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line.strip():
            end_sentence()
            continue
        if line.startswith("#"):
            body = line[1:].strip()
            key, _, value = (x.strip() for x in body.partition("="))
            if body.startswith(("newregion", "endregion")):
                name = body[9:].strip()
                if name and name != "s":
                    close(name)
                    if body.startswith("new"):
                        e.begin(name)
            elif body.startswith("newdoc"):
                close("par")
                close("p")
                close("doc")
                e.begin("doc", {"id": value or MISSING})
            elif body.startswith("newpar"):
                close("p")
                e.begin("p", {"id": value} if value else {})
            elif key in ("sent_id", "tuid", "parallel_id") and value:
                if key == "tuid" and not e.buffer and e.open and e.open[-1][0] == "p" and e.open[-1][1] == e.size and "tuid" not in e.open[-1][2]:
                    e.open[-1][2]["tuid"] = value
                else:
                    sent[key] = value
            elif value and re.fullmatch(r"[A-Za-z]\w*_\w+", key):
                kind, attr = key.split("_", 1)
                if kind == "s" or sentence_translation(key):
                    sent[key if kind != "s" else attr] = value
                else:
                    holder = next((o for o in reversed(e.open) if o[0] == kind), None)
                    if holder is None and kind == "text":
                        e.begin("text")
                        holder = e.open[-1]
                    if holder is not None:
                        holder[2][attr] = value
            continue
        cols = line.split("\t")
        if len(cols) < 8 or "." in cols[0]:
            continue
        if "-" in cols[0]:
            a, _, b = cols[0].partition("-")
            contractions.append((a, b, cols[1]))
            continue
        attrs = {k: v for k, v in zip(("form", "lemma", "upos", "xpos"), cols[1:5]) if v}
        attrs |= features(cols[5], split_feats)
        if cols[7]:
            attrs["deprel"] = cols[7]
        if sent.get("tuid") and len(cols) < 10:
            attrs["tuid"] = sent["tuid"]
        if len(cols) > 9:
            attrs |= {k: v for k, _, v in (p.partition("=") for p in cols[9].split("|")) if k in MISC and v}
        numbers[cols[0]] = e.size
        e.token(attrs, int(cols[6]) if re.fullmatch(r"[0-9]+", cols[6]) else None)
        words += 1
    end_sentence()
    for o in e.open:
        if o[0] == "text":
            o[2] |= {k: MISSING for k in TEXT_ATTRS if k not in o[2]}
    e.close()
    for i, r in enumerate(e.rows):
        if r[0] == "region" and r[1] == "text":
            e.rows[i] = (*r[:6], {k: MISSING for k in TEXT_ATTRS} | r[6], r[7])
    return e.rows


_TAG = re.compile(r"<(/?)([A-Za-z][\w.-]*)((?:\s+[\w:.-]+\s*=\s*\"[^\"]*\")*)\s*(/?)>\s*$")
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*\"([^\"]*)\"")
UPOS = {"ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"}
_COLUMNS = {"word": "form", "lc": "", "pos": "xpos", "msd": "feats"}


def parse_vertical(text: str, split_feats: bool = False) -> list:
    e, names = Events(), None
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if "positional-attributes:" in line:
            names = [_COLUMNS.get(n.lower(), n) for n in line.split("positional-attributes:")[1].split("-->")[0].split()]
            continue
        if not line.strip():
            e.end_sentence()
            continue
        m = _TAG.match(line.strip())
        if m:
            closing, name, attrs, empty = m.groups()
            attrs = dict(_ATTR.findall(attrs))
            if name == "s":  # delimits sentences
                if closing:
                    e.end_sentence(e.meta.pop("s", {}))
                else:
                    e.end_sentence()
                    e.meta["s"] = attrs
            elif empty:
                e.region(name, e.size, e.size - 1, attrs)
            elif closing:
                e.end(name)
            else:
                e.begin(name, attrs)
            continue
        if line.startswith("<!") or line.startswith("<?"):
            continue
        cols = line.split("\t")
        order = names or ["form", "lemma", "upos" if len(cols) > 2 and cols[2] in UPOS else "xpos", "feats"]
        attrs: dict = {}
        for n, v in zip(order, cols):
            if n and v:
                attrs |= features(v, split_feats) if n == "feats" else {n: v}
        e.token(attrs)
    e.end_sentence(e.meta.pop("s", {}))
    e.close()
    return e.rows


def parse_jsonl(text: str, split_feats: bool = False) -> list:
    e, positional, groups, meta = Events(), None, set(), {}
    for line in text.split("\n"):
        if not line.strip():
            continue
        x = json.loads(line)
        kind = x.get("type", "")
        if kind == "header" and x.get("positional"):
            positional, meta = x["positional"], x
            groups = set(x.get("token_groups", []))
            split_feats = split_feats or bool(x.get("split_feats"))
            e.rows.append(("header", "", 0, None, None, None, {"json": line}, None))
        elif kind == "token":
            pairs = list(zip(positional, x["v"])) if positional and x.get("v") else [(k, v) for k, v in x.items() if k in (positional or ("form", "lemma", "upos", "xpos", "deprel", "feats"))]
            attrs: dict = {}
            for k, v in pairs:
                if isinstance(v, str) and v and not (x.get("v") and v == MISSING):
                    attrs |= features(v, split_feats) if k == "feats" else {k: v}
            head = x.get("head")
            e.token(attrs, int(head) if isinstance(head, int) or isinstance(head, str) and head.isdigit() else None, x.get("tok_id"), x.get("head_tok_id"))
        elif kind == "sentence_end":
            e.end_sentence(_strings(x.get("attrs")))
        elif kind == "region_start":
            e.begin(x["struct"], _strings(x.get("attrs")), x.get("region_id"))
        elif kind == "region_end":
            e.end(x["struct"], x.get("region_id"))
        elif kind == "region":
            name, attrs = x.get("struct", ""), _strings(x.get("attrs"))
            if x.get("spans") and name in groups:
                e.group(name, [tuple(s) for s in x["spans"]], attrs)
            elif name == "s" and positional:
                e.end_sentence(attrs)  # its span is what was read, not what it says
            elif name:
                e.region(name, x.get("start_pos", e.size), x.get("end_pos", e.size - 1), attrs)
    e.end_sentence()
    e.close()
    del meta
    return e.rows


def _strings(attrs) -> dict:
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in (attrs or {}).items()}


_PIECES = re.compile(r"\(|\)|[^\s()]+")


def parse_brackets(text: str, as_pos: bool = False) -> list:
    """Penn-style trees: leaves are tokens, each constituent a ``node`` region with its category; one tree a sentence."""
    e, stack = Events(), []
    for m in _PIECES.finditer(text):
        x = m[0]
        if x == "(":
            stack.append([None, e.size, 0])
        elif x == ")":
            if not stack:
                continue
            label, start, leaf = stack.pop()
            if not (leaf and as_pos) and label is not None and e.size > start:
                e.region("node", start, e.size - 1, {"type": label})
            if not stack:
                e.end_sentence()
        elif stack and stack[-1][0] is None:
            stack[-1][0] = x
        elif stack:
            stack[-1][2] = 1
            e.token({"form": x, "xpos": stack[-1][0]} if as_pos else {"form": x, "xpos": stack[-1][0]})
    e.end_sentence()
    return e.rows


PARSERS = {"conllu": parse_conllu, "vertical": parse_vertical, "jsonl": parse_jsonl, "brackets": parse_brackets}


def events_of(frames, parse, split_feats: bool):
    """Events of whole files: frames of (file, value)."""
    for f in frames:
        for number, value in zip(f.file, f.value):
            rows = parse(value, split_feats) if parse is not parse_brackets else parse(value)
            out = pd.DataFrame(rows, columns=["kind", "name", "place", "stop", "sent", "head", "attrs", "spans"]).astype({"place": "Int64", "stop": "Int64", "sent": "Int64", "head": "Int64"})
            out.insert(0, "file", number)
            yield out


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole files with their number in the order of paths; only paths are ranked in one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    order = files.select("path").withColumn("file", F.row_number().over(W.orderBy("path")).cast("long") - 1)
    return files.join(order, "path").select("file", "value")


def read(spark: SparkSession, path: str, form: str, split_feats: bool = False) -> Corpus:
    """A corpus from files: form is conllu, vertical, jsonl or brackets."""
    parse = PARSERS[form]
    events = numbered_files(spark, path).mapInPandas(lambda it: events_of(it, parse, split_feats), f"file long, {EVENTS}")
    return assemble(events.persist())


def assemble(events: DataFrame) -> Corpus:
    """The corpus of parsed events. Attribute names (a small set) are gathered; rows are not."""
    spark = events.sparkSession
    base = F.shiftleft("file", FILE_BITS)
    header = events.where("kind = 'header'").select("attrs").limit(1).collect()
    meta = json.loads(header[0].attrs["json"]) if header else {}
    keys = events.where("kind <> 'header'").select("kind", "name", F.explode_outer(F.map_keys("attrs")).alias("key")).distinct().collect()
    attrs = sorted({r.key for r in keys if r.kind == "token" and r.key})
    attrs = [a for a in meta.get("positional", []) if a in attrs or a != "feats"] + [a for a in attrs if a not in meta.get("positional", [])]
    attrs = sorted(set(attrs) | {"form"}, key=lambda a: (a != "form", a != "lemma"))
    tok = events.where("kind = 'token'")
    value = lambda a: F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit(MISSING))
    tokens = tok.select((base + F.col("place")).alias("pos"), F.col("file").alias("text_idx"), (base + F.col("sent")).alias("s_idx"), (base + F.col("head")).alias("head_pos"), *[value(a).alias(a) for a in attrs])
    kinds = sorted({r.name for r in keys if r.kind == "region"})
    regions, region_attrs, modes = {}, {}, {}
    declared = {k: m for m in ("nested", "overlapping", "zerowidth") for k in meta.get(m, [])}
    for kind in kinds:
        names = sorted({r.key for r in keys if r.kind == "region" and r.name == kind and r.key})
        r = events.where((F.col("kind") == "region") & (F.col("name") == kind))
        r = r.select((base + F.col("place")).alias("start_pos"), (base + F.col("stop")).alias("end_pos"), F.col("file").alias("text_idx"), *[value(a).alias(a) for a in names])
        order = W.partitionBy("text_idx").orderBy("start_pos", F.desc("end_pos"), *names)
        r = r.withColumn("region_idx", F.shiftleft("text_idx", FILE_BITS) + F.row_number().over(order) - 1).withColumn("par", F.lit(None).cast("long"))
        regions[kind], region_attrs[kind] = r, names
        modes[kind] = declared.get(kind) or detected_mode(r)
        if modes[kind] == "nested":
            regions[kind] = with_parents(r)
        elif modes[kind] == "flat" and kind not in ("s",):
            cover = r.where("end_pos >= start_pos").select(F.explode(F.sequence("start_pos", "end_pos")).alias("pos"), F.col("region_idx").alias(f"{kind}_idx"))
            tokens = tokens.join(cover.withColumnRenamed(f"{kind}_idx", f"_{kind}"), "pos", "left")
            tokens = tokens.withColumn(f"{kind}_idx", F.col(f"_{kind}")).drop(f"_{kind}") if kind != "text" else tokens.withColumnRenamed("_text", "_text_region")
    if "s" in regions:  # sentences carry their own number
        s = regions["s"].drop("region_idx").join(tokens.groupBy(F.col("s_idx").alias("region_idx")).agg(F.min("pos").alias("start_pos")), "start_pos")
        regions["s"] = s
    if "text" in regions and "_text_region" in tokens.columns:
        # text_idx stays the file where no text region covers a token; regions carry the file as their partition
        offset = F.coalesce("_text_region", F.shiftleft("text_idx", FILE_BITS) + (1 << (FILE_BITS - 1)))
        regions = {k: r.join(tokens.select(F.col("pos").alias("start_pos"), offset.alias("_t")), "start_pos", "left").withColumn("text_idx", F.coalesce("_t", "text_idx")).drop("_t") for k, r in regions.items()}
        tokens = tokens.withColumn("text_idx", offset).drop("_text_region")
    if tokens.where("head_pos is not null").isEmpty():
        tokens = tokens.drop("head_pos")
    else:
        tokens = with_tree(tokens)
    groups = {}
    for kind in sorted({r.name for r in keys if r.kind == "group"}):
        g = events.where((F.col("kind") == "group") & (F.col("name") == kind))
        moved = F.transform("spans", lambda x: F.struct((base + x["s"]).alias("s"), (base + x["e"]).alias("e")))
        groups[kind] = g.select((base + F.row_number().over(W.partitionBy("file").orderBy("place", "stop", F.to_json("attrs")))).alias("gid"), F.col("file").alias("text_idx"), moved.alias("spans"), F.col("attrs").alias("props"))
    multivalue = set(meta.get("multivalue", []))
    feats = {"feats"} & set(attrs)
    return Corpus(tokens, attrs, regions, region_attrs, modes, multivalue, (set(meta.get("kv_pipe", [])) | feats) - multivalue, groups, meta.get("default_within", ""))


def detected_mode(regions: DataFrame) -> str:
    from .build import mode_of

    m = mode_of(regions).first()
    return "overlapping" if m.overlapping else "nested" if m.nested else "zerowidth" if m.zerowidth else "flat"


def read_cwb(spark: SparkSession, folder: str, attrs: list[str], regions: tuple = ()) -> Corpus:
    """CWB binaries: ``<attr>.lexicon`` (null-ended strings), ``<attr>.corpus`` (big-endian int32 ids), ``<region>.rng`` (pairs).

    Attribute files are one stream each, so one task reads one attribute; columns meet by position.
    """
    import numpy as np

    def column(frames):
        for f in frames:
            for attr, lexicon, ids in zip(f.attr, f.lexicon, f.ids):
                words = bytes(lexicon).split(b"\0")[:-1]
                ids = np.frombuffer(bytes(ids), dtype=">i4")
                for at in range(0, len(ids), 100_000):
                    part = ids[at : at + 100_000]
                    yield pd.DataFrame({"attr": attr, "pos": np.arange(at, at + len(part)), "v": [words[i].decode("utf-8", "replace") for i in part]})

    load = lambda name: spark.read.format("binaryFile").load(f"{folder}/{name}").select("content")
    tokens = None
    for a in attrs:
        pair = load(f"{a}.lexicon").select(F.lit(a).alias("attr"), F.col("content").alias("lexicon")).crossJoin(load(f"{a}.corpus").select(F.col("content").alias("ids")))  # one row each
        name = "form" if a == "word" else a
        col = pair.mapInPandas(column, "attr string, pos long, v string").select("pos", F.col("v").alias(name))
        tokens = col if tokens is None else tokens.join(col, "pos")
    tables = {}

    def pairs(frames):
        for f in frames:
            for content in f.content:
                x = np.frombuffer(bytes(content), dtype=">i4").reshape(-1, 2)
                yield pd.DataFrame({"region_idx": np.arange(len(x)), "start_pos": x[:, 0].astype("int64"), "end_pos": x[:, 1].astype("int64")})

    for r in regions:
        rows = load(f"{r}.rng").mapInPandas(pairs, "region_idx long, start_pos long, end_pos long")
        tables[r] = rows.select("*", F.lit(None).cast("long").alias("par"), F.lit(0).cast("long").alias("text_idx"))
    tokens = tokens.withColumn("text_idx", F.lit(0).cast("long"))
    names = ["form" if a == "word" else a for a in attrs]
    return Corpus(tokens, names, tables, {r: [] for r in regions}, {r: "overlapping" for r in regions})
