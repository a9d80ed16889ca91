"""Zipped documents: parts, guards, and their markup flattened to relations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import tasks

# The namespace of the markup and the parts that are read.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = ("word/document.xml", "word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/_rels/document.xml.rels")
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 2000, 50 << 20, 200 << 20, 200

#: Rows and bytes after which what a task has made goes back, so that it holds few archives at a time and a small one costs no frame of its own.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
_KINDS = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}

ENTRIES = "doc_id string, part_uri string, is_directory boolean, compressed_bytes long, uncompressed_bytes long, content binary, error string"


def _each_file(files: DataFrame, rows_of: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """What a function of the columns of a row tells of each archive or part, row by row, in batches of bounded size."""
    fields = pa.schema([(n, _KINDS[k]) for n, k in (c.split(" ") for c in schema.split(", "))])
    sized = [k for k, f in enumerate(fields) if f.type in (pa.string(), pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)
        rows, size = [], 0
        for batch in batches:
            for values in zip(*batch.columns):
                for row in rows_of(*(v.as_py() for v in values)):
                    rows.append(row)
                    size += sum(len(row[k] or "") for k in sized)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return files.mapInArrow(run, schema)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content): files below a folder, read as bytes by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def entries(files: DataFrame, with_content: bool = True) -> DataFrame:
    """A row for each entry of each archive; a file that is no archive gives one row with an error.

    An entry larger than the limit is told without its content and with an error, so that
    a small file cannot unfold into more than a task can hold.
    """

    def rows_of(doc, content):
        rows = []
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for e in z.infolist():
                    fits = with_content and not e.is_dir() and e.file_size <= MAX_ENTRY_BYTES
                    over = with_content and e.file_size > MAX_ENTRY_BYTES
                    rows.append((doc, e.filename, e.is_dir(), max(e.compress_size, 0), max(e.file_size, 0), z.read(e) if fits else None, "entry too large" if over else None))
        except (zipfile.BadZipFile, TypeError, OSError) as error:
            rows = [(doc, None, None, None, None, None, str(error))]
        return rows

    return _each_file(files.select("doc_id", "content"), rows_of, ENTRIES)


def part(rows: DataFrame, uri: str, required: bool = True) -> DataFrame:
    """(doc_id, text, error) of one part of each archive; a required part that is missing is an error."""
    # one pass: the entries of an archive are told together, and only what is asked for is sent with them
    own = F.when(F.col("part_uri") == uri, F.struct(F.col("content").cast("string").alias("text"), F.col("error").alias("__why")))
    docs = rows.groupBy("doc_id").agg(F.collect_list(own).alias("own")).select("doc_id", F.explode_outer("own").alias("o")).select("doc_id", "o.*")
    error = F.when(F.col("__why").isNotNull(), F.concat(F.col("__why"), F.lit(f": {uri}"))).when(F.col("text").isNull() & F.lit(required), F.lit(f"missing part: {uri}"))
    return docs.select("doc_id", "text", error.alias("error"))


def guarded(rows: DataFrame) -> DataFrame:
    """Which archives are too many, too large or too dense entries: (doc_id, entries, bytes, violation)."""
    files = rows.where(~F.coalesce("is_directory", F.lit(False)))
    out = files.groupBy("doc_id").agg(F.count("part_uri").alias("entries"), F.coalesce(F.sum("uncompressed_bytes"), F.lit(0)).alias("bytes"), F.max("uncompressed_bytes").alias("largest"), F.max(F.col("uncompressed_bytes") / F.greatest("compressed_bytes", F.lit(1))).alias("ratio"))
    why: Column = F.when(F.col("entries") > MAX_ENTRIES, "too many entries").when(F.col("largest") > MAX_ENTRY_BYTES, "entry too large").when(F.col("bytes") > MAX_TOTAL_BYTES, "archive too large").when(F.col("ratio") > MAX_RATIO, "compression ratio too high")
    return out.withColumn("violation", why)


def manifest(rows: DataFrame) -> DataFrame:
    """(doc_id, part_uri, sha, size) of every part."""
    return rows.where("content IS NOT NULL").select("doc_id", "part_uri", F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("size"))


def changed_parts(now: DataFrame, before: DataFrame) -> DataFrame:
    """Parts whose bytes are not those they had."""
    return manifest(now).join(manifest(before), ["doc_id", "part_uri", "sha"], "left_anti")


def packed(rows: DataFrame) -> DataFrame:
    """(doc_id, content): parts (doc_id, part_uri, content) as one archive each, entries in order of name."""

    def rows_of(doc, parts):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in parts:
                z.writestr(zipfile.ZipInfo(p["part_uri"]), p["content"])
        yield doc, buffer.getvalue()

    # markup shrinks so far in a shuffle that partitions joined by size would give a task thousands of large parts at once
    dealt = rows.repartition(tasks(rows.sparkSession), "doc_id")
    by = dealt.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_uri", "content"))).alias("parts"))
    return _each_file(by, rows_of, "doc_id string, content binary")


# Markup to relations.

PARAGRAPHS = "doc_id string, para_idx int, style_id string, num_id long, level int, table_idx int, row_idx int, cell_idx int, text string, tags array<string>"
RUNS = "doc_id string, para_idx int, run_idx int, rev_tag string, author string, bold boolean, italic boolean, underline boolean, color string, font string, size int, is_field_result boolean, text string"


def _value(node, path: str) -> str | None:
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(W + "val")


def _on(props, name: str) -> bool | None:
    found = props.find(W + name) if props is not None else None
    if found is None:
        return None
    return (found.get(W + "val") or "1").lower() not in ("0", "false", "off", "none")


def _pieces(run, state: list[str]) -> Iterator[tuple[str, bool]]:
    """Visible text of a run and whether it is a field's result; ``state`` is the stack of open fields."""
    for child in run:
        tag = child.tag.removeprefix(W)
        if tag == "fldChar":
            kind = child.get(W + "fldCharType")
            if kind == "begin":
                state.append("code")
            elif kind == "separate" and state:
                state[-1] = "result"
            elif kind == "end" and state:
                state.pop()
        elif "code" not in state:
            text = {"t": child.text or "", "delText": child.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(tag)
            if text:
                yield text, bool(state)


REVISIONS = ("ins", "del", "moveFrom", "moveTo")


def _flat_runs(paragraph) -> Iterator[tuple]:
    state: list[str] = []

    def walk(node, rev, author):
        for child in node:
            tag = child.tag.removeprefix(W)
            if tag == "r":
                props = child.find(W + "rPr")
                fonts = props.find(W + "rFonts") if props is not None else None
                size = _value(props, "sz")
                color = _value(props, "color")
                for text, result in _pieces(child, state):
                    yield rev, author, _on(props, "b"), _on(props, "i"), _on(props, "u"), None if color == "auto" else color, fonts.get(W + "ascii") if fonts is not None else None, int(size) if size else None, result, text
            elif tag in REVISIONS:
                yield from walk(child, tag, child.get(W + "author"))
            elif tag in ("hyperlink", "smartTag", "sdt", "sdtContent", "fldSimple"):
                yield from walk(child, rev, author)

    yield from walk(paragraph, None, None)


def _walk_body(root) -> Iterator[tuple]:
    """Paragraphs in document order with the table cell around each, of the outermost table."""
    table = -1

    def walk(node, cell):
        nonlocal table
        for child in node:
            tag = child.tag.removeprefix(W)
            if tag == "p":
                yield child, cell
            elif tag == "tbl" and cell == (None, None, None):
                table += 1
                own = table
                for r, row in enumerate(child.iter(W + "tr")):
                    for c, one in enumerate(row.findall(W + "tc")):
                        yield from walk(one, (own, r, c))
            else:
                yield from walk(child, cell)

    body = root.find(W + "body")
    yield from walk(body if body is not None else root, (None, None, None))


def _each_document(rows: DataFrame, uri: str, schema: str, flatten) -> DataFrame:
    """What ``flatten`` yields of the markup of a part, for each document; of one that is no markup, nothing."""

    def rows_of(doc, content):
        try:
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError:
            return
        for r in flatten(root):
            yield (doc, *r)

    return _each_file(rows.where((F.col("part_uri") == uri) & F.col("content").isNotNull()).select("doc_id", "content"), rows_of, schema)


def paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of the main part, in document order at any depth."""

    def flatten(root):
        for i, (p, cell) in enumerate(_walk_body(root)):
            props = p.find(W + "pPr")
            num, level = _value(props, "numPr/numId"), _value(props, "numPr/ilvl")
            text = "".join(r[-1] for r in _flat_runs(p))
            yield i, _value(props, "pStyle"), int(num) if num else None, int(level) if level else None, *cell, text, [c.tag.removeprefix(W) for c in p]

    return _each_document(rows, PARTS[0], PARAGRAPHS, flatten)


def runs(rows: DataFrame) -> DataFrame:
    """Visible runs of the main part with their formatting and revision wrapper."""

    def flatten(root):
        for i, (p, _) in enumerate(_walk_body(root)):
            for k, r in enumerate(_flat_runs(p)):
                yield i, k, *r

    return _each_document(rows, PARTS[0], RUNS, flatten)


def styles(rows: DataFrame) -> DataFrame:
    """Style definitions: what each is based on and its own properties."""

    def flatten(root):
        for s in root.iter(W + "style"):
            p, r = s.find(W + "pPr"), s.find(W + "rPr")
            size = _value(r, "sz")
            yield s.get(W + "styleId"), _value(s, "name"), _value(s, "basedOn"), _value(p, "jc"), _on(r, "b"), _on(r, "i"), int(size) if size else None

    return _each_document(rows, PARTS[1], "doc_id string, style_id string, name string, based_on string, align string, bold boolean, italic boolean, size int", flatten)


def number_levels(rows: DataFrame) -> DataFrame:
    """Levels of list definitions: instances joined to their definitions, start overrides applied."""

    def flatten(root):
        known = {a.get(W + "abstractNumId"): a for a in root.iter(W + "abstractNum")}
        for n in root.iter(W + "num"):
            base = known.get(_value(n, "abstractNumId"))
            over = {o.get(W + "ilvl"): _value(o, "startOverride") for o in n.iter(W + "lvlOverride")}
            for lv in base.iter(W + "lvl") if base is not None else ():
                ilvl = lv.get(W + "ilvl")
                yield int(n.get(W + "numId")), int(ilvl), int(over.get(ilvl) or _value(lv, "start") or 1), _value(lv, "numFmt") or "decimal", _value(lv, "lvlText") or "", _on(lv, "isLgl") or False

    return _each_document(rows, PARTS[2], "doc_id string, num_id long, level int, start int, format string, template string, is_legal boolean", flatten)


def footnotes(rows: DataFrame) -> DataFrame:
    """Footnotes with their type and text."""

    def flatten(root):
        for n in root.iter(W + "footnote"):
            yield int(n.get(W + "id") or 0), n.get(W + "type"), "".join(t.text or "" for t in n.iter(W + "t"))

    return _each_document(rows, PARTS[3], "doc_id string, note_id long, type string, text string", flatten)


def relationships(rows: DataFrame) -> DataFrame:
    """Hyperlink targets by relationship id."""

    def flatten(root):
        for r in root:
            if (r.get("Type") or "").endswith("/hyperlink"):
                yield r.get("Id"), r.get("Target")

    return _each_document(rows, PARTS[4], "doc_id string, rid string, target string", flatten)


def document_text(paras: DataFrame, separator: str = "\n") -> DataFrame:
    """The text of each document, a paragraph a line (or flat, with an empty separator)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"])
    return paras.groupBy("doc_id").agg(F.array_join(lines, separator).alias("text"))


def document_xml(texts: DataFrame) -> DataFrame:
    """A minimal main part for documents of (doc_id, paragraphs array<string>)."""
    from ..functions.text import escaped_xml

    ns = W.strip("{}")
    body = F.array_join(F.transform("paragraphs", lambda t: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), escaped_xml(t), F.lit("</w:t></w:r></w:p>"))), "")
    xml = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{ns}"><w:body>'), body, F.lit("</w:body></w:document>"))
    return texts.select("doc_id", F.lit(PARTS[0]).alias("part_uri"), xml.cast("binary").alias("content"))


def tracked_xml(atoms: DataFrame, author: str, date: str) -> DataFrame:
    """The main part of a comparison: atoms (doc_id, para_idx, atom_idx, status, text) as revision markup.

    With ``old_look`` and ``new_look``, runs have their looks (what goes the old, the rest
    the new one), and FormatChanged ones a record of the old; with ``move_group``, each
    run of atoms of one move lies between range marks of one id, named by the move.
    An atom has three ids of its own: of its wrapper, its record and the range it opens.
    """
    from ..functions.text import escaped_xml

    ns, s = W.strip("{}"), F.col("status")
    by = lambda kind, id_, more="": F.concat(F.lit(f'<w:{kind} w:id="'), id_.cast("string"), F.lit(f'"{more} w:author="{author}" w:date="{date}"'))
    own = lambda k: 3 * F.col("atom_idx") + k
    props = F.lit("")
    if "new_look" in atoms.columns:
        old, new = (F.coalesce(c, F.lit("")) for c in ("old_look", "new_look"))
        record = F.concat(by("rPrChange", own(2)), F.lit("><w:rPr>"), old, F.lit("</w:rPr></w:rPrChange>"))
        inner = F.when(s == "FormatChanged", F.concat(new, record)).when(s.isin("Deleted", "MovedSource"), old).otherwise(new)
        props = F.when(inner != "", F.concat(F.lit("<w:rPr>"), inner, F.lit("</w:rPr>"))).otherwise("")
    run = lambda tag: F.concat(F.lit("<w:r>"), props, F.lit(f'<w:{tag} xml:space="preserve">'), escaped_xml(F.col("text")), F.lit(f"</w:{tag}></w:r>"))
    wrap = lambda kind, inner: F.concat(by(kind, own(1)), F.lit(">"), inner, F.lit(f"</w:{kind}>"))
    piece = F.when(s == "Deleted", wrap("del", run("delText"))).when(s == "Inserted", wrap("ins", run("t"))).when(s == "MovedSource", wrap("moveFrom", run("t"))).when(s == "MovedDestination", wrap("moveTo", run("t"))).otherwise(run("t"))
    if "move_group" in atoms.columns:
        from ..operators.ordered import islands

        atoms = islands(atoms, ["doc_id"], "atom_idx", ["move_group", "status"])
        range_ = Window.partitionBy("doc_id", "island")
        atoms = atoms.withColumns({"opened": F.min("atom_idx").over(range_), "closed": F.max("atom_idx").over(range_)})
        kind = F.when(s == "MovedSource", "moveFrom").when(s == "MovedDestination", "moveTo")
        id_ = (3 * F.col("opened") + 3).cast("string")
        start = F.concat(F.lit("<w:"), kind, F.lit('RangeStart w:id="'), id_, F.lit('" w:name="move'), F.col("move_group").cast("string"), F.lit(f'" w:author="{author}" w:date="{date}"/>'))
        stop = F.concat(F.lit("<w:"), kind, F.lit('RangeEnd w:id="'), id_, F.lit('"/>'))
        at = lambda place, mark: F.when(F.col("move_group").isNotNull() & (F.col("atom_idx") == F.col(place)), F.coalesce(mark, F.lit(""))).otherwise("")
        piece = F.concat(at("opened", start), piece, at("closed", stop))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c]), "")
    paras = atoms.withColumn("piece", piece).withColumn("o", F.col("atom_idx")).groupBy("doc_id", "para_idx").agg(joined("piece").alias("inner"))
    paras = paras.select("doc_id", F.col("para_idx").alias("o"), F.concat(F.lit("<w:p>"), "inner", F.lit("</w:p>")).alias("p"))
    xml = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{ns}"><w:body>'), joined("p"), F.lit("</w:body></w:document>"))
    return paras.groupBy("doc_id").agg(xml.cast("binary").alias("content")).withColumn("part_uri", F.lit(PARTS[0]))


def variants(atoms: DataFrame, author: str, date: str) -> DataFrame:
    """(doc_id, variant, content): each comparison (pair_id, orig_para, rev_para, atom_idx, status, text) as two archives, clean and tracked."""
    from ..lineage import settled
    from ..operators.alignment import side_text

    atoms = settled(atoms)  # read twice, and a comparison is the dear part
    clean = side_text(atoms, True).select(F.col("pair_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("paragraphs"))
    # a paragraph that was deleted whole stands where it was, before what follows it
    first = F.min("atom_idx").over(Window.partitionBy("pair_id", "orig_para", "rev_para"))
    rows = atoms.select(F.col("pair_id").cast("string").alias("doc_id"), first.alias("para_idx"), "atom_idx", "status", "text")
    told = lambda df, name: packed(df).select("doc_id", F.lit(name).alias("variant"), "content")
    return told(document_xml(clean), "clean").unionByName(told(tracked_xml(rows, author, date), "tracked"))


def save(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write archives (doc_id, variant, content) by variant; what stands there already is kept unless told otherwise."""
    files.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("variant").parquet(path)
