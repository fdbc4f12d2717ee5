"""Operator 9: text of web pages without site-wide noise, by a site style tree.

The DOMs of a host's pages are merged from the root down: elements at one place whose children have the same sequence of tags and classes share a style node, and their children are merged in turn. An
element's presentation importance is the entropy, with the number m of pages that have it as base, of which style node a page uses; a content node's (text or image) is one less the
mean of log_m(n) over its occurrences, n being the pages with the same content at that place. Composite importance is (1 - g^l) presentation + g^l (mean over pages of the mean over the children), with g = 0.9 and l style nodes.
A branch whose importance, and that of everything below it, is under ``THRESHOLD`` is noise; the largest such branches are cut from each page, and what text is left is returned. What fewer than ``MIN_PAGES`` pages have is important (1); equal pages of a host count as one, so that copies don't make content look like a template.

Scale: nothing groups all pages of a host. A first map emits a hash for each style; those that two or more pages share are few (templates), and only they and what hangs directly below them are counted
by a second map and a shuffle with map-side sums. The recursion over a host's tree sees a row for each shared node, not for each page. Both sets that tasks look up, shared styles and noise branches, grow with
the number of templates, so their sizes are checked: beyond ``MAX_SET`` the counting takes all styles and the cut gets each page's noise by a join, with the same result.

Defined cases: the host is that of the url, lower-cased (a null url or one without host: the host ""); a null html gives a null text, an empty one or one of plain text that text; unclosed, misnested and unknown tags never fail, and take time in proportion to the page:
an end tag without start is ignored, what looks like a tag without an end is text, elements end with their parents, p and li end before the next of them; script, style, noscript, template, head, svg and comments have no text; a host with fewer than ``MIN_PAGES`` different pages loses nothing;
repeated rows get equal texts; page_id may be null or repeated; an empty table gives no rows; further columns are ignored, whatever their names.

Result: page_id, host, text (blocks on lines of their own), branches_removed.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

DAMPING = 0.9
THRESHOLD = 0.5
MIN_PAGES = 5  # what fewer pages have isn't judged, and important
MAX_SET = 4_000_000

_NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
_STOP = re.compile("[>\"']")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SRC = re.compile(r"""\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template head svg".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd label mark q s samp small span strong sub sup time tt u var".split())
_SCOPE = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th tr ul".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


class Node:
    __slots__ = ("tag", "sign", "children", "content")

    def __init__(self, tag: str, sign: str, content: str = "") -> None:
        self.tag, self.sign, self.children, self.content = tag, sign, [], content


def parse(page: str) -> Node:
    """The DOM of a page, with content in leaves of tag "#text" and "img". Takes time in proportion to the page, whatever it holds."""
    root = Node("#root", "#root")
    stack, at, end, begin = [root], 0, len(page), 0
    place: dict[str, list[int]] = {}  # where in the stack elements of a tag are
    scopes = [0]
    quotes = {q: page.rfind(q) for q in "\"'"}
    heed = True

    def text(a: int, b: int) -> None:
        words = page[a:b].split()
        if words:
            content = entities.unescape(" ".join(words))
            stack[-1].children.append(Node("#text", "#text", content))

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            place[node.tag].pop()
            if node.tag in _SCOPE:
                scopes.pop()

    def tag_end(i: int) -> int:
        """The place of the ">" that ends a tag, outside quotes; -1 if there is none. Once quotes leave a tag without an end, they aren't heeded for the rest of the page."""
        nonlocal heed
        j = i
        while heed:
            m = _STOP.search(page, j)
            if m is None:
                heed = False
            elif m[0] == ">":
                return m.start()
            else:
                j = page.index(m[0], m.end()) + 1 if m.start() < quotes[m[0]] else m.end()
        return page.find(">", i)

    while at < end:
        i = page.find("<", at)
        if i < 0:
            break
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 4)
            text(begin, i)
            begin = at = end if stop < 0 else stop + 3
            continue
        m = _NAME.match(page, i + 1)
        if m is None:
            at = i + 1
            if page[at : at + 1] not in ("!", "?"):
                continue
        stop = page.find(">", at) if m is None else tag_end(m.end())
        if stop < 0:  # no tag ends from here on
            break
        text(begin, i)
        begin = at = stop + 1
        if m is None:
            continue
        tag, attributes = m[2].lower(), page[m.end() : stop]
        if m[1]:
            if place.get(tag):
                close(place[tag][-1])
            continue
        if tag in _RAW:
            done = None if attributes.endswith("/") else _RAW_END[tag].search(page, at)
            begin = at = at if attributes.endswith("/") else done.end() if done else end
            continue
        if tag == "p" or tag == "li" or tag in _SCOPE:
            ends = place.get("li" if tag == "li" else "p")
            if ends and ends[-1] > scopes[-1]:
                close(ends[-1])
        c = _CLASS.search(attributes) if "lass" in attributes or "LASS" in attributes else None
        node = Node(tag, f"{tag}.{c[1] or c[2] or c[3] or ''}" if c else tag)
        if tag == "img":
            s = _SRC.search(attributes)
            node.content = (s[1] or s[2] or s[3] or "") if s else ""
        stack[-1].children.append(node)
        if tag not in _VOID and not attributes.endswith("/"):
            place.setdefault(tag, []).append(len(stack))
            if tag in _SCOPE:
                scopes.append(len(stack))
            stack.append(node)
    text(begin, end)
    return root


def _hash(*parts) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


def style_of(key: int, node: Node) -> int:
    return _hash(key, "|".join([c.sign for c in node.children]))


def host_key(host: str) -> int:
    return _hash("host", host)


def styles(root: Node, key: int) -> list[int]:
    """The style keys of all elements of a page that have children."""
    out, todo = [], [(root, key)]
    while todo:
        node, key = todo.pop()
        if node.children:
            style = style_of(key, node)
            out.append(style)
            todo += [(c, _hash(style, i)) for i, c in enumerate(node.children) if c.children]
    return out


def shared_nodes(root: Node, key: int, shared) -> list[tuple[int, int, bool, int]]:
    """(node, parent style, leaf, variant) of the nodes below shared styles, the root among them; variant 0: a style no other page has."""
    out, todo = [], [(root, key, 0)]
    while todo:
        node, key, parent = todo.pop()
        if not node.children:
            out.append((key, parent, True, _hash("content", node.tag, node.content)))
            continue
        style = style_of(key, node)
        known = shared is None or style in shared
        out.append((key, parent, False, style if known else 0))
        if known:
            todo += [(c, _hash(style, i), style) for i, c in enumerate(node.children)]
    return out


def noise(rows: list[tuple[int, int, bool, int, int, float]], root: int, threshold: float = THRESHOLD) -> list[int]:
    """The noise branches of a host, of rows (node, parent style, leaf, variant, pages, importance of a leaf)."""
    below: dict[int, set[int]] = {}
    variants: dict[int, list[tuple[int, int]]] = {}
    leaf: dict[int, list[tuple[int, float]]] = {}
    for node, parent, is_leaf, variant, n, importance in rows:
        below.setdefault(parent, set()).add(node)
        if is_leaf:
            leaf.setdefault(node, []).append((n, importance))
        else:
            variants.setdefault(node, []).append((variant, n))
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for style, _ in variants.get(node, ()) if style for c in below.get(style, ())]
    value: dict[int, float] = {}
    most: dict[int, float] = {}  # the greatest importance in the branch
    for node in reversed(order):
        own, alone = variants.get(node, []), leaf.get(node, [])
        m = sum(n for _, n in own) + sum(n for n, _ in alone)
        if m < MIN_PAGES:
            value[node] = most[node] = 1.0
            continue
        entropy = inner = 0.0
        l, top = 0, 0.0
        for style, n in own:
            if style and n > 1:
                children = [value[c] for c in below.get(style, ()) if c in value]
                mean = sum(children) / len(children) if children else 1.0
                entropy -= n / m * math.log(n / m, m)
                inner += n / m * mean
                l += 1
                top = max(top, *(most[c] for c in below.get(style, ()) if c in most), 0.0)
            else:  # styles of one page each
                entropy += n / m
                inner += n / m
                l += n
                top = 1.0
        for n, importance in alone:
            inner += n / m * importance
            l += 1
            entropy -= n / m * math.log(n / m, m)
        if own:
            weight = DAMPING**l
            value[node] = (1 - weight) * entropy + weight * inner
        else:
            value[node] = inner
        most[node] = max(top, value[node])
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if most[node] < threshold:
            out.append(node)
        else:
            todo += [c for style, n in variants.get(node, ()) if style for c in below.get(style, ())]
    return out


def extract(root: Node, key: int, cut) -> tuple[str, int]:
    """(the text that is left, the number of branches cut). cut: keys of noise branches, or None."""
    blocks: list[list[str]] = [[]]
    removed = 0
    todo: list = [(root, key)]
    while todo:
        item = todo.pop()
        if item is None:
            if blocks[-1]:
                blocks.append([])
            continue
        node, key = item
        if cut and key in cut:
            removed += 1
            continue
        if node.tag == "#text":
            blocks[-1].append(node.content)
            continue
        block = node.tag not in _INLINE
        if block:
            todo.append(None)
        if node.children:
            style = style_of(key, node) if cut else 0
            todo += [(c, _hash(style, i) if cut else 0) for i, c in reversed(list(enumerate(node.children)))]
        if block:
            todo.append(None)
    return "\n".join(" ".join(b) for b in blocks if b), removed


def _each(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            yield parse(page), host_key(host)


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(s for root, key in _each([batch]) for s in styles(root, key))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["style", "n"])


def _nodes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        for batch in batches:
            seen: Counter = Counter()
            for root, key in _each([batch]):
                seen.update((key, *row) for row in shared_nodes(root, key, known))
            keys = list(zip(*seen)) if seen else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(keys, kinds)), pa.array(seen.values(), pa.int64())], ["host", "node", "parent", "leaf", "variant", "n"])

    return run


def _noise(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("node", "parent", "leaf", "variant", "n", "importance")))]
    yield pa.RecordBatch.from_arrays([pa.array(noise(rows, key[0].as_py()), pa.int64())], ["node"])


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[n[0] for n in shared_nodes(root, key, None)] for root, key in _each([batch])]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(found, pa.list_(pa.int64()))], ["rid", "nodes"])


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])


def _result(rows: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r and r[0] for r in rows], pa.string()), pa.array([r and r[1] for r in rows], pa.int32())], ["text", "removed"], mask=pa.array([r is None for r in rows], pa.bool_()))


def extracted(pages: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """The text of each page without the noise of its site."""
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", host.alias("host"), F.col("html").cast("string").alias("html"))
    rid = F.xxhash64("host", "html")
    copies = stored(rows.where("html IS NOT NULL").groupBy(rid.alias("same")).agg(F.count("*").alias("n"), F.min("page_id").alias("one")).where("n > 1").select("same", "one"), "site-copies")
    real = rows.where("html IS NOT NULL").join(F.broadcast(copies) if copies.count() <= max_set else copies, rid == F.col("same"), "left").where("same IS NULL OR page_id <=> one")
    if copies.head(1):  # copies of a page count as one page, also those with one page_id or none
        real = real.where("same IS NULL").unionByName(real.where("same IS NOT NULL").dropDuplicates(["same"]))
    real = real.select("host", "html")
    shared = stored(real.mapInArrow(_styles, "style bigint, n bigint").groupBy("style").agg(F.sum("n").alias("n")).where("n > 1").select("style"), "site-styles")
    few = shared.count() <= max_set
    known = spark.sparkContext.broadcast(frozenset(shared.toArrow()["style"].to_pylist())) if few else None  # its size was just checked
    counted = stored(real.mapInArrow(_nodes(known), "host bigint, node bigint, parent bigint, leaf boolean, variant bigint, n bigint").groupBy("host", "node", "parent", "leaf", "variant").agg(F.sum("n").alias("n")), "site-nodes")
    if not few:  # styles of one page were counted each; they take the form of those the shared set leaves out
        counted = counted.join(shared.withColumnRenamed("style", "parent"), "parent", "left_semi").unionByName(counted.where("parent = 0")).withColumn("variant", F.when(~F.col("leaf") & (F.col("n") < 2), F.lit(0)).otherwise(F.col("variant"))).groupBy("host", "node", "parent", "leaf", "variant").agg(F.sum("n").alias("n"))
    leaves = counted.where("leaf").groupBy("host", "node", "parent").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"))
    leaves = leaves.select("host", "node", "parent", F.lit(True).alias("leaf"), F.lit(0).cast("bigint").alias("variant"), F.col("m").alias("n"), F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log(F.col("m").cast("double"))).otherwise(F.lit(1.0)).alias("importance"))
    tree = counted.where("NOT leaf").withColumn("importance", F.lit(1.0)).unionByName(leaves)
    cut = stored(tree.groupBy("host").applyInArrow(_noise, "node bigint"), "site-noise")
    if few and cut.count() <= max_set:
        noisy = spark.sparkContext.broadcast(frozenset(cut.toArrow()["node"].to_pylist()))  # its size was just checked

        @F.arrow_udf(_RESULT)
        def clean(hosts: pa.Array, htmls: pa.Array) -> pa.Array:
            return _result([None if p is None else extract(parse(p), host_key(h), noisy.value) for h, p in zip(hosts.to_pylist(), htmls.to_pylist())])

        done = rows.withColumn("r", clean("host", "html"))
    else:

        @F.arrow_udf(_RESULT)
        def clean(hosts: pa.Array, htmls: pa.Array, cuts: pa.Array) -> pa.Array:
            return _result([None if p is None else extract(parse(p), host_key(h), frozenset(c or ())) for h, p, c in zip(hosts.to_pylist(), htmls.to_pylist(), cuts.to_pylist())])

        keyed = rows.withColumn("rid", rid)
        nodes = keyed.where("html IS NOT NULL").select("rid", "host", "html").mapInArrow(_page_nodes, "rid bigint, nodes array<bigint>").select("rid", F.explode("nodes").alias("node"))
        of_page = nodes.join(cut.distinct(), "node").groupBy("rid").agg(F.collect_set("node").alias("cuts"))
        done = keyed.join(of_page, "rid", "left").withColumn("r", clean("host", "html", "cuts"))
    return done.select("page_id", "host", F.col("r.text").alias("text"), F.coalesce("r.removed", F.lit(0)).alias("branches_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
