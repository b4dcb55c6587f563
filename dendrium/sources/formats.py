"""Treebank formats: readers from text to trees, writers back, and the node table of parsed trees.

parse_* take the text of one tree and return (Tree, words). read_trees() is the distributed reader: blocks are cut with
DataFrame functions where the format allows it, parsed in Arrow batches, and come out as rows of the node table.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.functions.treetools import Tree, canonical

ESCAPES = (("(", "#LRB#"), (")", "#RRB#"))


def escape(word: str | None) -> str:
    """A missing word is an empty one; brackets are named."""
    for a, b in ESCAPES:
        word = (word or "").replace(a, b)
    return word


def unescape(word: str) -> str | None:
    for a, b in ESCAPES:
        word = word.replace(b, a)
    return word or None


def parse_bracket(text: str) -> tuple[Tree, list]:
    """(L kid kid ...); a kid is a tree or a word; an empty kid is an open node."""
    words: list = []
    tokens = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def go():
        nonlocal at
        if tokens[at] != "(":
            raise ValueError(f"a bracket is missing in {text!r}")
        at += 1
        label = ""
        if at < len(tokens) and tokens[at] not in "()":
            label = tokens[at]
            at += 1
        kids: list = []
        while True:
            if at >= len(tokens):
                raise ValueError(f"a bracket is not closed in {text!r}")
            if tokens[at] == ")":
                at += 1
                break
            if tokens[at] == "(":
                kids.append(go())
            else:
                kids.append(len(words))
                words.append(unescape(tokens[at]))
                at += 1
        if not kids:
            kids.append(len(words))
            words.append(None)
        return Tree(label, tuple(kids))

    out = go()
    if at != len(tokens):
        raise ValueError(f"there is text after the tree in {text!r}")
    return out, words


def parse_discbracket(text: str) -> tuple[Tree, list]:
    """Leaves are number=word; what follows a tab is a comment."""
    tree, raw = parse_bracket(text.split("\t")[0])
    found = {}
    place = {}
    for i, w in enumerate(raw):
        m = re.fullmatch(r"(\d+)=(.*)", w or "", re.DOTALL)
        if not m:
            raise ValueError(f"{w!r} is no numbered word")
        place[i] = int(m[1])
        found[int(m[1])] = unescape(m[2])

    def go(t):
        return Tree(t.label, tuple(go(k) if isinstance(k, Tree) else place[k] for k in t.kids))

    return go(tree), [found.get(i) for i in range(max(found) + 1)]


def write_bracket(tree: Tree, words: list) -> str:
    """For continuous trees."""
    return f"({tree.label} {' '.join(write_bracket(k, words) if isinstance(k, Tree) else escape(words[k]) for k in tree.kids)})"


def write_discbracket(tree: Tree, words: list) -> str:
    return f"({tree.label} {' '.join(write_discbracket(k, words) if isinstance(k, Tree) else f'{k}={escape(words[k])}' for k in tree.kids)})"


def parse_export(lines: list[str], functions: str = "leave", morphology: str = "no", lemmas: str = "no") -> tuple[Tree, list]:
    """The lines between #BOS and #EOS: word, (lemma,) tag, morphology, function, parent, secondary edges in pairs. Lines with
    an odd number of fields have a lemma. functions: leave, add (L-F) or replace; morphology: no, add (L/M) or replace;
    lemmas: no, add (w/l) or replace."""
    rows = []
    for line in lines:
        f = line.split()
        if len(f) % 2:  # word, tag, morph, func, parent and pairs: no lemma
            f = [f[0], "--", *f[1:]]
        rows.append(f[:6])
    words, kids = [], {}
    for f in rows:
        name, lemma, tag, morph, func, parent = f
        label = tag
        if functions == "add" and func not in ("--", ""):
            label += "-" + func
        elif functions == "replace":
            label = func
        node = re.fullmatch(r"#(\d{3,})", name)
        if not node:
            if morphology == "add" and morph != "--":
                label += "/" + morph
            elif morphology == "replace":
                label = morph
            kids.setdefault(parent, []).append((label, None, len(words)))
            words.append(name if lemmas == "no" or lemma == "--" else lemma if lemmas == "replace" else f"{name}/{lemma}")
        else:
            kids.setdefault(parent, []).append((label, node[1], None))

    def build(label, key, at):
        if key is None:
            return Tree(label, (at,))
        return Tree(label, tuple(build(*k) for k in kids.get(key, [])))

    return canonical(Tree("ROOT", tuple(build(*k) for k in kids["0"]))), words


def write_export(tree: Tree, words: list, sentid: str = "1") -> str:
    """Numbers nodes from 500, children before parents; the root is node 0."""
    inner, parent, tag = [], {}, {}

    def number(t):
        for k in t.kids:
            if isinstance(k, Tree):
                if k.is_tag():
                    tag[k.kids[0]] = (k.label, t)
                else:
                    number(k)
                    parent[id(k)] = t
                    inner.append(k)

    number(tree)
    no = {id(k): 500 + i for i, k in enumerate(inner)} | {id(tree): 0}
    out = [f"#BOS {sentid}"]
    out += ["\t".join([words[i] or "", tag[i][0], "--", "--", str(no[id(tag[i][1])])]) for i in range(len(words))]
    out += ["\t".join([f"#{no[id(k)]}", k.label, "--", "--", str(no[id(parent[id(k)])])]) for k in inner]
    return "\n".join([*out, f"#EOS {sentid}"])


def parse_tiger(text: str) -> tuple[Tree, list]:
    """One <s> element; a node with two parents is rejected."""
    s = ET.fromstring(text)
    words, tags, kids, parents = [], {}, {}, {}
    for t in s.iter("t"):
        tags[t.get("id")] = Tree(t.get("pos"), (len(words),))
        words.append(t.get("word"))
    labels = {}
    for n in s.iter("nt"):
        labels[n.get("id")] = n.get("cat")
        for e in n.findall("edge"):
            child = e.get("idref")
            if child in parents:
                raise ValueError(f"{child} has two parents")
            parents[child] = n.get("id")
            kids.setdefault(n.get("id"), []).append(child)

    def build(key):
        return tags[key] if key in tags else Tree(labels[key], tuple(build(k) for k in kids.get(key, [])))

    tops = [k for k in (*labels, *tags) if k not in parents]
    return canonical(Tree("ROOT", tuple(build(k) for k in tops))), words


def parse_alpino(text: str) -> tuple[Tree, list]:
    """One alpino_ds element; nodes that only point to an index elsewhere are left out."""
    ds = ET.fromstring(text)
    words = ds.findtext("sentence").split()

    def build(n):
        if n.get("word") is not None:
            return Tree(n.get("pos") or n.get("pt"), (int(n.get("begin")),))
        kids = tuple(x for x in map(build, n.findall("node")) if x is not None)
        return Tree(n.get("cat"), kids) if kids else None

    return canonical(Tree("ROOT", (build(ds.find("node")),))), words


def parse_ftb(text: str) -> tuple[Tree, list]:
    """One SENT element: phrases are elements, words <w cat=...>; a word of several words is a node MW<cat>."""
    words: list = []

    def build(e):
        if e.tag == "w":
            parts = e.findall("w")
            cat = e.get("cat") or e.get("catint") or "X"
            if parts:
                return Tree("MW" + cat, tuple(build(p) for p in parts))
            words.append((e.text or "").strip())
            return Tree(cat, (len(words) - 1,))
        return Tree(e.tag, tuple(x for x in map(build, e) if x.kids))

    return build(ET.fromstring(text)), words


PARSERS = {
    "bracket": parse_bracket, "discbracket": parse_discbracket, "export": lambda t: parse_export(t.split("\n")), "tiger": parse_tiger, "alpino": parse_alpino, "ftb": parse_ftb,
}


def node_rows(tree: Tree, words: list) -> list[tuple]:
    """Rows (nid, last, parent, ix, nsib, nchild, depth, label, word, is_word, s, e, leaves, fanout) in preorder; s and e
    follow the order in the tree."""
    rows: list = []
    place = {x: i for i, x in enumerate(tree.leaves())}

    def go(t, parent, ix, nsib, depth):
        nid = len(rows)
        rows.append(None)
        if not isinstance(t, Tree):
            rows[nid] = (nid, nid, parent, ix, nsib, 0, depth, words[t], words[t], True, place[t], place[t] + 1, [t], 1)
            return
        for i, k in enumerate(t.kids, 1):
            go(k, nid, i, len(t.kids), depth + 1)
        own = sorted(t.leaves())
        spots = [place[x] for x in own]
        gaps = 1 + sum(b - a > 1 for a, b in zip(own, own[1:], strict=False))
        rows[nid] = (nid, len(rows) - 1, parent, ix, nsib, len(t.kids), depth, t.label, None, False, min(spots), max(spots) + 1, own, gaps)

    go(tree, None, 1, 1, 0)
    return rows


NODE_SCHEMA = (
    "corpus string, sentno long, nid int, last int, parent int, ix int, nsib int, nchild int, depth int, label string, word string, is_word boolean, s int, e int, leaves array<int>, fanout int"
)


def blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(corpus, sentno, block): a file is a corpus; sentno counts trees from 1. Files are read whole, one to a row, so that
    order and line numbers are those of the file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("corpus"), "value")
    if kind in ("bracket", "discbracket"):
        rows = files.select("corpus", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("i", "block"))
    elif kind == "export":
        rows = files.select("corpus", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?ms)^#BOS [^\n]*\n(.*?)\n#EOS"), F.lit(1))).alias("i", "block"))
    else:
        tag = {"tiger": "s", "alpino": "alpino_ds", "ftb": "SENT"}[kind]
        rows = files.select("corpus", F.posexplode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))).alias("i", "block"))
    return rows.select("corpus", (F.col("i") + 1).cast("long").alias("sentno"), "block")


def parsed(rows: DataFrame, kind: str, robust: bool = False) -> DataFrame:
    """The node table of (corpus, sentno, block); with robust, blocks that cannot be parsed are left out."""
    parse = PARSERS[kind]

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for corpus, sentno, block in zip(pdf.corpus, pdf.sentno, pdf.block, strict=True):
                try:
                    tree, words = parse(block)
                except (ValueError, KeyError, IndexError, ET.ParseError):
                    if robust:
                        continue
                    raise
                out += [(corpus, sentno, *r) for r in node_rows(tree, words)]
            df = pd.DataFrame(out, columns=names)
            df["parent"] = df["parent"].astype("Int32")
            yield df

    return rows.mapInPandas(run, NODE_SCHEMA)


def read_trees(spark: SparkSession, path: str, kind: str, robust: bool = False) -> DataFrame:
    return parsed(blocks(spark, path, kind), kind, robust)


def trees_of(nodes: DataFrame) -> DataFrame:
    """(corpus, sentno, tree): discontinuous bracket strings of a node table, built bottom-up, one level a join."""
    text = F.when(F.col("is_word"), F.concat(F.element_at("leaves", 1).cast("string"), F.lit("="), F.col("word")))
    rows = nodes.select("corpus", "sentno", F.struct("nid", "parent", "is_word", "label", text.alias("text")).alias("n"))

    def run(pdf):
        import pandas as pd

        nodes_ = sorted(pdf.n, key=lambda x: -x["nid"])
        below: dict = {}
        for x in nodes_:
            own = x["text"] if x["is_word"] else f"({x['label']} {' '.join(reversed(below.pop(x['nid'])))})"
            below.setdefault(-1 if pd.isna(x["parent"]) else int(x["parent"]), []).append(own)
        return pd.DataFrame({"corpus": [pdf.corpus.iloc[0]], "sentno": [pdf.sentno.iloc[0]], "tree": [below[-1][0]]})

    return rows.groupBy("corpus", "sentno").applyInPandas(run, "corpus string, sentno long, tree string")


def write_trees(nodes: DataFrame, path: str) -> None:
    """One discontinuous bracket tree a line, in order, a folder for each corpus."""
    trees_of(nodes).repartition("corpus").sortWithinPartitions("corpus", "sentno").select("corpus", F.col("tree").alias("value")).write.partitionBy("corpus").text(path)


def write_conll(words: list, tags: list[str], heads: dict[int, int]) -> str:
    """Lines of ten fields; heads are numbered from 1, the root's is 0."""
    return "\n".join("\t".join([str(i + 1), w, "_", tags[i], tags[i], "_", str(heads[i] + 1), "_", "_", "_"]) for i, w in enumerate(words))


def write_mst(words: list, tags: list[str], heads: dict[int, int]) -> str:
    return "\n".join(["\t".join(words), "\t".join(tags), "\t".join(["_"] * len(words)), "\t".join(str(heads[i] + 1) for i in range(len(words)))])
