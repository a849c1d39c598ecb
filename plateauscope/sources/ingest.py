"""Readers of sweep exports, declared ranges and back-test reports.

Text tables are read as splittable lines in UTF-8 or UTF-16, never as one string per file: the
place of a row in its file comes from the block offset and the order inside the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import (REPORT_PATTERN, comma_vote, dot_vote, metric_role,
                                 strip_number, text_to_number, to_number)
from ..operators.ordering import attach
from ..plans.stages import stage

HEADER_ROWS = 12
SET_LINE = r"(?im)^[A-Za-z_][\w]*\s*=\s*.+\|\|.+\|\|.+\|\|.+\|\|[YN]"


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, line_no, b): the bytes between separators, in file order, from splittable reads."""
    df = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").cast("binary").alias("value"))
    return number_records(df).withColumnRenamed("value", "b")


def number_records(df: DataFrame) -> DataFrame:
    sizes = df.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0))
                         .alias("_start"))
    # One block of a file is one input split, so this window is bounded by its size.
    w = Window.partitionBy("file", "_block").orderBy("_mid")
    return df.join(sizes, ["file", "_block"]).select(
        "file", (F.col("_start") + F.row_number().over(w) - 1).alias("line_no"), "value")


def charsets(pieces: DataFrame) -> DataFrame:
    """(file, charset) by the byte-order mark at the head of each file; UTF-8 without one."""
    heads = pieces.groupBy("file").agg(F.min_by(F.substring("b", 1, 2), "line_no").alias("_h"))
    head = F.hex("_h")
    return heads.select("file", F.when(head == "FFFE", "UTF-16LE").when(
        head == "FEFF", "UTF-16BE").otherwise("UTF-8").alias("charset"))


def text_of(b: Column, charset: Column) -> Column:
    """Text of whole code units, without a byte-order mark; an odd last byte is dropped."""
    even = F.substring(b, F.lit(1), (F.octet_length(b) - F.octet_length(b) % 2).cast("int"))
    text = F.when(charset == "UTF-16LE", F.decode(even, "UTF-16LE")).when(
        charset == "UTF-16BE", F.decode(even, "UTF-16BE")).otherwise(b.cast("string"))
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, charset, line_no, value): the lines of text files in UTF-8 or UTF-16, in file order.

    Files are cut at the byte 0A whatever their encoding, so that every file splits. In UTF-16 that
    byte ends a line only as half of a code unit: with a zero behind it at an even place (little
    endian) or before it at an odd one (big endian). Places are running sums of lengths, block by block,
    and pieces that no line end parts are joined again. The encodings are looked up first; lines of
    UTF-16 files are written on the way, because later steps read them several times.
    """
    from ..operators.ordering import row_block, running_totals
    pieces = read_pieces(spark, path, "\n")
    known = stage(charsets(pieces), "charsets")
    p = attach(pieces, known, ["file"], "inner", "line_no")
    plain = p.filter("charset = 'UTF-8'").select("file", "charset", "line_no",
                                                 text_of(F.col("b"), F.col("charset")).alias("value"))
    if known.filter("charset <> 'UTF-8'").isEmpty():
        return plain
    wide = (p.filter("charset <> 'UTF-8'").withColumn("_n", F.octet_length("b").cast("long") + 1)
            .withColumn("_blk", row_block("line_no")))
    # Behind the byte 0A:
    wide = stage(running_totals(stage(wide, "pieces"), ["file"], "_blk", ["line_no"], {"_end": "_n"}),
                 "placed")
    start, little = F.col("_end") - F.col("_n"), F.col("charset") == "UTF-16LE"
    zero = lambda at: F.hex(F.substring("b", at, 1)) == "00"
    # Little endian: a line begins with the second half of the line end before it.
    begins = little & (start % 2 == 1) & zero(1)
    ends = ~little & (F.col("_end") % 2 == 0) & zero(-1)
    wide = wide.withColumn("_begins", begins).withColumn("_cut", (begins | ends).cast("long"))
    wide = running_totals(wide.withColumn("_ends", ends), ["file"], "_blk", ["line_no"], {"_line": "_cut"})
    line = F.col("_line") - F.when(F.col("_ends"), 1).otherwise(0)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "b", "_begins", "_ends")))
    lines = wide.withColumn("_at", line).groupBy("file", "charset", "_at").agg(parts.alias("_p"))
    body = F.aggregate(F.slice("_p", 2, F.size("_p")), F.col("_p")[0]["b"], lambda acc, x: F.concat(
        acc, F.unhex(F.lit("0A")), x["b"]))
    skip = F.when(F.col("_p")[0]["_begins"], 1).otherwise(0)
    drop = F.when(F.element_at("_p", -1)["_ends"], 1).otherwise(0)
    body = F.substring(body, skip + 1, F.octet_length(body) - skip - drop)
    lines = stage(lines.select("file", "charset", F.col("_at").alias("line_no"),
                               text_of(body, F.col("charset")).alias("value")), "lines")
    # What stands behind the last line end is no line if it is empty.
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    lines = attach(lines, last, ["file"], "inner", "line_no").filter(
        (F.col("line_no") < F.col("_last")) | (F.col("value") != "")).drop("_last")
    return plain.unionByName(lines)


def read_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, line_no, value): the records of every file in file order, in UTF-8 or UTF-16.

    With ``separator`` (ASCII) a file is cut there, in its own encoding; the path is read once for
    every encoding that occurs.
    """
    if separator is None:
        return read_lines(spark, path).select(
            "file", "line_no", F.regexp_replace("value", "\\r$", "").alias("value"))
    known = stage(charsets(read_pieces(spark, path, "\n")), "charsets")
    written = {"UTF-8": separator, "UTF-16LE": "".join(c + "\0" for c in separator),
               "UTF-16BE": "".join("\0" + c for c in separator)}
    out, kinds = None, [r["charset"] for r in known.select("charset").distinct().collect()]
    for kind in kinds:  # three at most
        part = attach(read_pieces(spark, path, written[kind]),
                      known.filter(F.col("charset") == kind), ["file"], "inner", "line_no")
        part = part.select("file", "line_no", text_of(F.col("b"), F.col("charset")).alias("value"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "file string, line_no long, value string")
    return out if kinds in ([], ["UTF-8"]) else stage(out, "records")


def delimiter_of(header: Column) -> Column:
    """Tab, semicolon or comma, whichever the header line holds most of."""
    count = lambda ch: F.length(header) - F.length(F.replace(header, F.lit(ch), F.lit("")))
    tabs, semis, commas = count("\t"), count(";"), count(",")
    return F.when((tabs >= semis) & (tabs >= commas), "\t").when(semis >= commas, ";").otherwise(",")


def split_line(line: Column, delimiter: Column) -> Column:
    """Fields of a delimited line; quotes may hold the delimiter and doubled quotes."""
    d = F.when(delimiter == "\t", "\\t").otherwise(delimiter)
    pattern = F.concat(F.lit('(?:^|(?<=['), d, F.lit(']))("(?:[^"]|"")*"|[^'), d, F.lit(']*)(?=['),
                       d, F.lit(']|$)'))
    fields = F.regexp_extract_all(line, pattern, F.lit(1))
    return F.transform(fields, lambda f: F.trim(F.when(
        f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"')))
        .otherwise(f)))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, delimiter, col_idx, text): long cells of delimited tables."""
    lines = read_records(spark, path).withColumn(
        "value", F.regexp_replace("value", "\\r$", "")).filter(F.trim("value") != "")
    heads = lines.groupBy("file").agg(F.min_by("value", "line_no").alias("_h"))
    heads = heads.select("file", delimiter_of(F.col("_h")).alias("delimiter"))
    rows = attach(lines, heads, ["file"], "inner", "line_no")
    return rows.select("file", "line_no", "delimiter", F.posexplode(
        split_line(F.col("value"), F.col("delimiter"))).alias("col_idx", "text")).withColumn(
        "is_number", F.lit(False))


def _entities(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                     ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def read_spreadsheet_xml(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of XML spreadsheets: the first worksheet with more than one row.

    Records end at the row tag, so a large sheet is read by many tasks. A worksheet
    number is the running count of the opening tags, summed over blocks of lines.
    """
    from ..operators.ordering import row_block, running_totals
    rec = read_records(spark, path, "</Row>")
    opens = F.regexp_count("value", F.lit("<Worksheet\\b"))
    rec = rec.withColumn("_o", opens.cast("long")).withColumn("_blk", row_block("line_no"))
    rec = running_totals(rec, ["file"], "_blk", ["line_no"], {"sheet": "_o"})
    rec = rec.filter(F.col("value").rlike("<Row\\b"))
    body = F.regexp_extract("value", "(?s)<Row\\b[^>]*>(.*)$", 1)
    rows = rec.select("file", "sheet", "line_no", body.alias("_b"))
    n = rows.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = n.groupBy("file").agg(F.min("sheet").alias("sheet"))
    rows = attach(rows, first, ["file", "sheet"], "inner", "line_no")
    tags = F.regexp_extract_all("_b", F.lit("(?s)(<Cell\\b[^>]*?(?:/>|>.*?</Cell>))"), F.lit(1))
    # Column of a cell: its explicit index, else one after the previous cell.
    place = F.aggregate(tags, F.array().cast("array<int>"), lambda acc, t: F.array_append(
        acc, F.coalesce(F.regexp_extract(t, 'ss:Index="(\\d+)"', 1).try_cast("int"),
                        F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + 1)))
    cells = rows.select("file", "line_no", F.explode(F.arrays_zip(
        tags.alias("t"), place.alias("c"))).alias("x"))
    t = F.col("x.t")
    number = t.rlike('ss:Type="Number"')
    text = _entities(F.regexp_replace(F.regexp_extract(t, "(?s)<Data\\b[^>]*>(.*?)</Data>", 1),
                                      "<[^>]+>", ""))
    empty = ~t.rlike("<Data\\b") | (number & (F.trim(text) == ""))
    return cells.select("file", "line_no", (F.col("x.c") - 1).alias("col_idx"),
                        F.when(~empty, text).alias("text"), number.alias("is_number"))


def locate_header(cells: DataFrame) -> DataFrame:
    """Header line per file: first of 12 rows with 3 filled cells and no decimal number."""
    filled = F.coalesce(F.trim("text"), F.lit("")) != ""
    v = F.col("text").try_cast("double")
    decimal = F.col("is_number") & (v != F.floor(v))
    rows = cells.groupBy("file", "line_no").agg(
        F.count_if(filled).alias("_f"), F.max(F.coalesce(filled & decimal, F.lit(False)))
        .alias("_d"))
    first = rows.groupBy("file").agg(F.min("line_no").alias("first_line"))
    ok = rows.filter("_f >= 3 AND NOT _d").join(first, "file").filter(
        F.col("line_no") - F.col("first_line") < HEADER_ROWS).groupBy("file").agg(
        F.min("line_no").alias("_l"))
    return first.join(ok, "file", "left").select(
        "file", F.coalesce("_l", "first_line").alias("header_line"))


def finish_table(cells: DataFrame) -> DataFrame:
    """Named cells below the header: unnamed columns and empty rows are gone.

    Adds ``decimal``, the mark inferred for the column, and ``num``.
    """
    at = locate_header(cells)
    c = attach(cells, at, ["file"], "inner", "line_no")
    heads = c.filter("line_no = header_line AND trim(text) <> ''").select(
        "file", "col_idx", F.trim("text").alias("header"))
    body = attach(c.filter("line_no > header_line"), heads, ["file", "col_idx"], "inner", "line_no")
    live = body.filter("text <> ''").select("file", "line_no").distinct()
    body = body.join(live, ["file", "line_no"], "left_semi")
    body = attach(body, decimal_marks(body), ["file", "col_idx"], "left", "line_no")
    num = F.when(F.col("is_number"), F.col("text").try_cast("double")).when(
        F.col("decimal").isNotNull(), F.coalesce(
            text_to_number(F.col("text"), F.col("decimal")), to_number(F.col("text")))).otherwise(
        to_number(F.col("text")))
    return body.select("file", "line_no", "col_idx", "header", "text", "decimal", num.alias("num"))


def decimal_marks(body: DataFrame) -> DataFrame:
    """Decimal mark per column by votes of its texts; the delimiter is the hint."""
    text = ~F.col("is_number") & F.col("text").isNotNull()
    hint = (F.max(F.when(F.col("delimiter") == ";", ",").when(F.col("delimiter") == ",", "."))
            if "delimiter" in body.columns else F.lit(None).cast("string"))
    g = body.groupBy("file", "col_idx").agg(
        F.count_if(text & comma_vote(F.col("text"))).alias("_c"),
        F.count_if(text & dot_vote(F.col("text"))).alias("_d"), hint.alias("_h"))
    return g.select("file", "col_idx", F.col("_c").alias("comma_votes"),
                    F.col("_d").alias("dot_votes"),
                    F.when((F.col("_c") > 0) & (F.col("_d") == 0), ",")
                    .when((F.col("_d") > 0) & (F.col("_c") == 0), ".")
                    .when((F.col("_c") == 0) & (F.col("_d") == 0), F.col("_h")).alias("decimal"))


def file_roles(heads: DataFrame) -> DataFrame:
    """Role of each file from its name and opening text: set, report, oos or is.

    ``heads``: file, head (the first part of the text).
    """
    h = F.col("head")
    role = (F.when(F.lower("file").endswith(".set"), "set")
            .when(F.lower("file").rlike("\\.html?$"), "report")
            .when(h.rlike(SET_LINE), "set")
            .when(h.rlike(REPORT_PATTERN), "report")
            .when(h.rlike("(?i)Forward\\s*Result|Resultado\\s*(del\\s*)?forward|Back\\s*Result"),
                  "oos").otherwise("is"))
    return heads.select("file", role.alias("role"))


def table_role(heads: DataFrame) -> DataFrame:
    """Role of each parsed table from its headers (file, header)."""
    fwd = metric_role(F.col("header")).isin("forward_result", "back_result")
    return heads.groupBy("file").agg(F.when(F.max(F.coalesce(fwd, F.lit(False))), "oos")
                                     .otherwise("is").alias("role"))


def parse_ranges(lines: DataFrame) -> DataFrame:
    """Declared ranges from ``name=value||start||step||stop||flag`` lines.

    ``lines``: study_id, line_no, value.
    """
    t = F.trim(F.regexp_replace("value", "\\r$", ""))
    r = lines.select("study_id", "line_no", t.alias("t")).filter(
        "t <> '' AND NOT startswith(t, ';') AND locate('=', t) > 1")
    at = F.locate("=", F.col("t"))
    r = r.withColumn("name", F.trim(F.col("t").substr(F.lit(1), at - 1))).withColumn(
        "parts", F.split(F.trim(F.col("t").substr(at + 1, F.length("t"))), "\\|\\|"))
    full = F.size("parts") >= 5
    part = lambda i: F.when(full, F.trim(F.get("parts", F.lit(i))))
    flag = lambda i: F.when(F.lower(part(i)).isin("true", "false"), F.lower(part(i)) == "true")
    num = lambda i: F.when(part(i).rlike("^-?\\s*\\d"), to_number(part(i)))
    return r.filter("name <> ''").select(
        "study_id", "line_no", "name", F.trim(F.get("parts", F.lit(0))).alias("raw"),
        num(1).alias("start"), num(2).alias("step"), num(3).alias("stop"),
        flag(1).alias("bool_start"), flag(3).alias("bool_stop"),
        F.coalesce(F.upper(part(4)).startswith("Y"), F.lit(False)).alias("enabled"),
        full.alias("has_range"))


# Labels of the report figures.
REPORT_LABELS = {
    "profit": "(?i)beneficio\\s*neto|total\\s*net\\s*profit|gesamtnettogewinn",
    "profit_factor": "(?i)factor\\s*de\\s*beneficio|profit\\s*factor|profitfaktor",
    "recovery_factor": "(?i)factor\\s*de\\s*recuperaci|recovery\\s*factor",
    "sharpe": "(?i)ratio\\s*de\\s*sharpe|sharpe\\s*ratio",
    "expected_payoff": "(?i)beneficio\\s*esperado|expected\\s*payoff",
    "trades": "(?i)total\\s*de\\s*operaciones|total\\s*trades|gesamtzahl\\s*der\\s*trades",
    "drawdown": "(?i)reducci[oó]n\\s*relativa\\s*de\\s*la\\s*equidad|equity\\s*drawdown\\s*relative",
    "symbol": "(?i)^s[ií]mbolo$|^symbol$",
    "period": "(?i)^per[ií]odo$|^period$",
}


def report_rows(reports: DataFrame) -> DataFrame:
    """(report_id, row_no, cells) of the table rows of HTML reports (report_id, html)."""
    rows = F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    r = reports.select("report_id", F.posexplode(rows).alias("row_no", "_r"))
    cells = F.regexp_extract_all("_r", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    # Most cells are plain numbers, without a tag or a reference to replace.
    clean = F.transform(cells, lambda c: F.trim(F.when(
        c.contains("<") | c.contains("&"), _entities(F.regexp_replace(c, "<[^>]+>", ""))).otherwise(c)))
    return r.select("report_id", "row_no", clean.alias("cells"))


def report_figures(rows: DataFrame) -> DataFrame:
    """Labelled values of each report: a cell that ends in ':' labels the next filled cell."""
    # Labels and values share a row of the report, so the next cell is found inside the row and only
    # labels go on. An element is a label with its place and value.
    filled = F.filter(F.transform("cells", lambda x, i: F.struct(i.alias("c"), x.alias("text"))),
                      lambda x: x["text"] != "")
    pairs = F.zip_with("_f", F.slice(F.col("_f"), 2, F.greatest(F.size("_f"), F.lit(1))), lambda x, y: F.struct(
        x["c"].alias("c"), x["text"].alias("text"), y["text"].alias("value")))
    labelled = rows.filter(F.exists("cells", lambda x: x.endswith(":"))).withColumn("_f", filled)
    pair = labelled.select("report_id", "row_no", F.inline(pairs)).filter(
        F.col("text").endswith(":") & F.col("value").isNotNull()).withColumn(
        "label", F.trim(F.regexp_replace("text", ":$", "")))
    first = lambda k: F.min_by("value", F.when(F.col("label").rlike(REPORT_LABELS[k]), F.struct(
        "row_no", "c")))
    g = pair.groupBy("report_id").agg(*[first(k).alias(k) for k in REPORT_LABELS])
    day = lambda i: F.to_date(F.translate(F.get(F.regexp_extract_all(
        "period", F.lit("(\\d{4}[./-]\\d{2}[./-]\\d{2})"), F.lit(1)), F.lit(i)), "./", "--"))
    pct = to_number(F.regexp_extract("drawdown", "(-?[\\d\\s.,]+)\\s*%", 1))
    return g.select("report_id", "symbol", day(0).alias("from_day"), day(1).alias("to_day"),
                    *[to_number(F.col(k)).alias(k) for k in (
                        "profit", "profit_factor", "recovery_factor", "sharpe",
                        "expected_payoff", "trades")], pct.alias("drawdown"))


def report_inputs(rows: DataFrame) -> DataFrame:
    """Inputs of each report: the block of name=value rows under the inputs label."""
    head = F.get("cells", F.lit(0))
    start = rows.filter(head.rlike("(?i)par[aá]metros\\s*de\\s*entrada|^inputs\\s*:?$")).groupBy(
        "report_id").agg(F.min("row_no").alias("_s"))
    line = F.get(F.filter(F.slice("cells", 2, 1000), lambda x: x.contains("=")), F.lit(0))
    # A row goes on with its first input only, and without one as a place where the block may end.
    r = rows.select("report_id", "row_no", line.alias("l"),
                    (F.coalesce(F.trim(head), F.lit("")) != "").alias("_ends"))
    r = r.filter("l IS NOT NULL OR _ends").join(start, "report_id").filter(F.col("row_no") >= F.col("_s"))
    stop = r.filter((F.col("row_no") > F.col("_s")) & F.col("_ends"))
    stop = stop.groupBy("report_id").agg(F.min("row_no").alias("_e"))
    r = r.filter("l IS NOT NULL").join(stop, "report_id", "left").filter(
        F.col("_e").isNull() | (F.col("row_no") < F.col("_e")))
    pat = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    r = r.filter(F.col("l").rlike(pat)).select(
        "report_id", "row_no", F.regexp_extract("l", pat, 1).alias("name"),
        F.trim(F.regexp_extract("l", pat, 2)).alias("text"))
    return r.groupBy("report_id", "name").agg(F.min_by("text", "row_no").alias("text"))


def report_deals(rows: DataFrame) -> DataFrame:
    """Deals table of each report, columns found by their multi-language titles."""
    low = F.transform("cells", lambda x: F.lower(x))
    at = lambda pat: F.array_position(F.transform(low, lambda x: x.rlike(pat)), True)
    cols = {"time": "fecha|time|zeit", "type": "^tipo$|^type$",
            "direction": "^direcci|^direction$|^richtung$", "volume": "^volumen$|^volume$",
            "price": "^precio$|^price$|^preis$", "symbol": "^s[ií]mbolo$|^symbol$",
            "commission": "^comisi|^commission$", "swap": "^swap$",
            "profit": "^beneficio$|^profit$|^gewinn$", "balance": "^balance$|^saldo$"}
    h = rows.filter(F.size("cells") >= 8).select(
        "report_id", "row_no", *[at(p).cast("int").alias(f"_{k}") for k, p in cols.items()])
    h = h.filter("_profit > 0 AND _type > 0")
    first = h.groupBy("report_id").agg(F.min_by(F.struct(*h.columns[1:]), "row_no").alias("_h"))
    r = rows.join(first, "report_id").filter(
        (F.col("row_no") > F.col("_h.row_no")) & (F.size("cells") >= F.col("_h._profit")))
    cell = lambda k: F.when(F.col(f"_h._{k}") > 0, F.get("cells", F.col(f"_h._{k}") - 1))
    num = lambda k: to_number(cell(k))
    stamp = F.coalesce(
        F.try_to_timestamp(F.translate(cell("time"), ".", "-")),
        F.timestamp_seconds((cell("time").try_cast("double") - 25569) * 86400))
    r = r.filter(~F.lower(cell("type")).rlike("balance|credit|deposit"))
    return r.select("report_id", "row_no", stamp.alias("ts"), F.lower(cell("type")).alias("type"),
                    F.lower(cell("direction")).alias("direction"), cell("symbol").alias("symbol"),
                    num("volume").alias("volume"), num("price").alias("price"),
                    F.coalesce(num("commission"), F.lit(0.0)).alias("commission"),
                    F.coalesce(num("swap"), F.lit(0.0)).alias("swap"),
                    num("profit").alias("profit"), num("balance").alias("balance"))
