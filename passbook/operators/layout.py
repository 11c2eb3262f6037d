"""Statement rows from positioned words: lines, columns, bands and carried headers, for all documents at once.

words(doc_id, page, text, x0, top): a page is one group, small by nature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions.text import normalize_table_header, strip
from passbook.functions.values import looks_like_date
from passbook.sources.raw import choose_rows, pages_without_text, text_rows, usable_tables  # noqa: F401  the page predicates belong here too
from passbook.sources.steps import small, written

# fixed values: labels of statement columns and what headers call them
LABELS = {
    "SlNo": ["slno", "sno", "serial", "serial no"],
    "Transaction Date": ["date", "transaction date", "txn date", "tran date", "posting date", "transaction"],
    "Value Date": ["value date", "val date", "value"],
    "Particulars": ["particulars", "description", "narration", "remarks", "transaction details", "details"],
    "Cheque Number": ["cheque number", "cheque no", "chq no", "chq ref no", "cheque", "chq", "instrument no"],
    "Withdrawals": ["withdrawals", "withdrawal", "debit", "debit amount", "withdrawal amount", "withdrawal amt", "dr"],
    "Deposits": ["deposits", "deposit", "credit", "credit amount", "deposit amount", "deposit amt", "cr"],
    "Balance Amount": ["balance amount", "balance", "closing balance", "available balance", "running balance"],
}

#: Units by which a word's top may differ from its line's first word.
LINE_GAP = 2.0


def label_of(c: Column) -> Column:
    """The canonical label of a header cell; null if it is none."""
    # one lookup, so that the form is made once and not for each label
    return F.try_element_at(F.create_map(*(F.lit(x) for label, names in LABELS.items() for n in names for x in (n, label))), normalize_table_header(c))


def is_header_row(cells: Column) -> Column:
    """Whether cells name a date, particulars, and withdrawals, deposits or a balance."""
    found = F.transform(cells, label_of)
    # a cell that is no label is null among them, and a search that doesn't find gives null then
    return F.coalesce(F.array_contains(found, "Transaction Date") & F.array_contains(found, "Particulars") & F.arrays_overlap(found, F.array(*map(F.lit, ["Withdrawals", "Deposits", "Balance Amount"]))), F.lit(False))


def lines(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """words with line: on its page the number, from 1, of the line that a word is on.

    In order of top and x0 a word joins the line of the word before it if it lies within `gap` of
    that line's first word, else it begins a line. A step of more than `gap` always begins one, so the words
    between two such steps are a chain that is folded alone: most often one line. A column bottom stays.
    """
    own = ["top", "x0", "text", *(["bottom"] if "bottom" in words.columns else [])]
    page = Window.partitionBy("doc_id", "page").orderBy("top", "x0", "text")
    steps = words.where(strip("text") != "").select("doc_id", "page", *own, F.lag("top").over(page).alias("_before"))
    begins = F.col("_before").isNull() | (F.col("top") - F.col("_before") > gap)
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    chained = steps.select("doc_id", "page", *own, F.max(F.when(begins, F.col("top"))).over(upto).alias("_chain"))
    chain = chained.groupBy("doc_id", "page", "_chain").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("ws"), F.max("top").alias("_last"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        new = acc["anchor"].isNull() | (w["top"] - acc["anchor"] > gap)
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(new, w["top"].cast("double")).otherwise(acc["anchor"]).alias("anchor"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    one = F.array_repeat(F.lit(1), F.size("ws"))
    numbered = chain.withColumn("ns", F.when(F.col("_last") - F.col("_chain") <= gap, one).otherwise(F.aggregate("ws", start, step)["out"]))
    rows = numbered.select("doc_id", "page", "_chain", F.explode(F.arrays_zip("ws", "ns")).alias("z")).select("doc_id", "page", "_chain", F.col("z.ns").alias("_n"), *(f"z.ws.{c}" for c in own))
    at = F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("_chain", "_n"))
    return rows.select("doc_id", "page", at.cast("int").alias("line"), *own)


def line_text(lined: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): each line's words from left to right."""
    ws = F.array_sort(F.collect_list(F.struct("x0", "top", "text")))
    return lined.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("text"))


def headers(lined: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, page, line, top, labels, starts) of each page's first line with `least` labels, among them date, particulars and balance.

    Labels and the x0 at which they start are in order of x0; of two words with one label the first counts.
    """
    hits = lined.withColumn("label", label_of(F.col("text"))).where("label is not null")
    per = hits.groupBy("doc_id", "page", "line", "label").agg(F.min("x0").alias("x"), F.min("top").alias("top"))
    found = per.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x", "label"))).alias("cols"), F.min("top").alias("top"))
    names = F.transform("cols", lambda c: c["label"])
    good = found.withColumn("labels", names).where((F.size("labels") >= least) & F.array_contains("labels", "Transaction Date") & F.array_contains("labels", "Particulars") & F.array_contains("labels", "Balance Amount"))
    best = good.groupBy("doc_id", "page").agg(F.min_by(F.struct("line", "top", "labels", F.transform("cols", lambda c: c["x"]).alias("starts")), "line").alias("h"))
    return best.select("doc_id", "page", "h.*")


def column_of(starts: Column, x0: Column) -> Column:
    """The last column that starts at x0 + 1 or before; -1 left of the first."""
    return F.size(F.filter(starts, lambda s: s <= x0 + 1)) - 1


def joined_words() -> Column:
    """As an aggregate: the words of one cell in order of top and x0."""
    ws = F.array_sort(F.collect_list(F.when(strip("text") != "", F.struct("top", "x0", "text"))))
    return F.array_join(F.transform(ws, lambda w: strip(w["text"])), " ")


def _cells(banded: DataFrame, keys: list[str], width: str = "n") -> DataFrame:
    """banded(keys, column, n, words): one row of n cells for each key."""
    cell = banded.where("column >= 0").groupBy(*keys, width, "column").agg(joined_words().alias("cell"))
    row = cell.groupBy(*keys, width).agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("m"))
    made = F.transform(F.sequence(F.lit(0), F.col(width) - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return row.select(*keys, made.alias("cells"))


def carried_headers(pages: DataFrame, found: DataFrame) -> DataFrame:
    """For each of pages(doc_id, page) the header found on it, else the last one before; own tells whether it is the page's."""
    h = found.select("doc_id", "page", F.struct("line", "top", "labels", "starts").alias("h"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    out = pages.select("doc_id", "page").distinct().join(h, ["doc_id", "page"], "left").withColumn("c", F.last("h", ignorenulls=True).over(before))
    return out.where("c is not null").select("doc_id", "page", "c.labels", "c.starts", F.when(F.col("h").isNotNull(), F.col("c.top")).alias("top"), F.when(F.col("h").isNotNull(), F.col("c.line")).alias("line"), F.col("h").isNotNull().alias("own"))


def banded_rows(words: DataFrame, header: DataFrame, anchor: Column, slack: float = 2.0, ends: DataFrame | None = None, least: int = 1, lead: bool = True) -> DataFrame:
    """(doc_id, page, band, cells): rows of words below the header, each from an anchor word to the next one.

    anchor: whether a word (with its column and text) begins a band, which reaches from slack above
    it. Words above the first anchor make band 0, kept if lead. ends(doc_id, page, end): where a page's
    body ends, if not at its last word. Pages with fewer than `least` anchors give nothing.
    """
    placed = words.join(header.select("doc_id", "page", "labels", "starts", F.coalesce("top", F.lit(float("-inf"))).alias("_head")).hint("shuffle_hash"), ["doc_id", "page"])
    placed = placed.where(F.col("top") > F.col("_head") + 2).withColumn("column", column_of(F.col("starts"), F.col("x0"))).withColumn("n", F.size("starts"))
    if ends is not None:
        placed = placed.join(ends.select("doc_id", "page", F.col("end").alias("_end")).hint("shuffle_hash"), ["doc_id", "page"], "left").where(F.col("_end").isNull() | (F.col("top") < F.col("_end")))
    # an anchor opens its band for all words from slack above it on
    marked = placed.withColumn("_a", F.coalesce(anchor, F.lit(False))).withColumn("_key", F.when(F.col("_a"), F.col("top") - slack).otherwise(F.col("top")))
    page = Window.partitionBy("doc_id", "page")
    in_order = page.orderBy("_key", F.desc("_a")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = marked.withColumn("band", F.count_if("_a").over(in_order)).withColumn("_anchors", F.count_if("_a").over(page)).where(F.col("_anchors") >= least)
    if not lead:
        bands = bands.where("band > 0")
    return _cells(bands, ["doc_id", "page", "band"])


def date_rows(words: DataFrame, header: DataFrame, least: int = 2) -> DataFrame:
    """Bands that begin at a date in the date column, of pages whose header has five columns or more; a stacked table row falls apart so."""
    wide = header.where(F.size("starts") >= 5)
    date_column = F.array_position("labels", F.lit("Transaction Date")) - 1
    return banded_rows(words, wide, (F.col("column") == date_column) & looks_like_date("text"), least=least)


def serial_rows(words: DataFrame, header: DataFrame) -> DataFrame:
    """Bands that begin at a serial number in the first column, of pages whose header starts with one; a line that begins "statement generated on" ends the page."""
    own = header.where((F.get("labels", F.lit(0)) == "SlNo") & (F.size("labels") >= 6))
    told = line_heads(lines(words)).join(own.select("doc_id", "page", F.coalesce("top", F.lit(float("-inf"))).alias("_head")).hint("shuffle_hash"), ["doc_id", "page"])
    ends = told.where((F.col("top") > F.col("_head")) & F.col("norm").startswith("statement generated on")).groupBy("doc_id", "page").agg((F.min("top") - 2).alias("end"))
    return banded_rows(words, own, (F.col("column") == 0) & strip("text").rlike(r"^\d+$"), ends=ends, lead=False)


def line_heads(lined: DataFrame) -> DataFrame:
    """(doc_id, page, line, top, bottom, raw, norm): of each line its least top, greatest bottom, text in lower case and text as a header's."""
    bottom = "bottom" if "bottom" in lined.columns else "top"
    ws = F.array_sort(F.collect_list(F.struct("x0", "top", "text")))
    out = lined.groupBy("doc_id", "page", "line").agg(F.min("top").alias("top"), F.max(bottom).alias("bottom"), F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("_t"))
    return out.select("doc_id", "page", "line", "top", "bottom", F.lower("_t").alias("raw"), normalize_table_header("_t").alias("norm"))


# fixed values: labels of statements whose one date column begins each row, and their words without signs and blanks
SECTION_LABELS = {
    "Date": ["date", "transactiondate", "trandate", "txndate"],
    "Particulars": ["particulars", "description", "narration", "remarks"],
    "Cheque Number": ["chqno", "chq", "chequeno", "chequenumber", "instrumentno"],
    "Withdrawals": ["withdrawal", "withdrawals", "debit"],
    "Deposits": ["deposit", "deposits", "credit"],
    "Balance Amount": ["balance", "closingbalance"],
}
SERIAL_WORDS = ["slno", "sno", "serial"]
#: Units by which a column starts left of its label; other columns start half-way from the label before.
LABEL_MARGINS = {"Date": 10.0, "Particulars": 2.0, "Cheque Number": 15.0}
#: Below this a page's first header leaves room for rows of the page before.
FIRST_HEADER = 250.0
# fixed values: lines that end a section, and one that moves its beginning
SECTION_STOPS, SECTION_SKIP, SECTION_SITE = "cumulative totals", "transaction details page", "finacle.ubi.com"


def section_headers(lined: DataFrame) -> DataFrame:
    """(doc_id, page, section, top, bottom, end, labels, starts): the sections of each page, from each header line to the next.

    A header line has all labels but for the cheque's, no serial column and one date word at most.
    Where the first header lies low on its page, a section with the same columns begins at the top.
    """
    word = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")
    label = F.coalesce(*(F.when(F.col("_w").isin(*names), F.lit(n)) for n, names in SECTION_LABELS.items()))
    marked = lined.withColumn("_w", word).withColumn("_label", label)
    kinds = marked.groupBy("doc_id", "page", "line").agg(F.count_if(F.col("_w").isin(*SERIAL_WORDS)).alias("_serials"), F.count_if(F.col("_w") == "date").alias("_dates"), F.min("top").alias("top"), F.max("bottom" if "bottom" in lined.columns else "top").alias("bottom"))
    first = marked.where("_label is not null").groupBy("doc_id", "page", "line", "_label").agg(F.min("x0").alias("x"))
    cols = first.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x", F.col("_label").alias("label")))).alias("cols")).withColumn("labels", F.transform("cols", lambda c: c["label"]))
    need = F.array(*(F.lit(n) for n in SECTION_LABELS if n != "Cheque Number"))
    good = cols.join(kinds.where("_serials = 0 and _dates < 2").hint("shuffle_hash"), ["doc_id", "page", "line"]).where(F.size(F.array_except(need, "labels")) == 0)
    margin = F.create_map(*(F.lit(x) for kv in LABEL_MARGINS.items() for x in kv))

    def start(c: Column, i: Column) -> Column:
        before = F.coalesce(F.get("cols", i - 1)["x"], F.element_at("cols", -1)["x"])
        own = F.try_element_at(margin, c["label"])
        return F.when(own.isNotNull(), c["x"] - own).otherwise((before + c["x"]) / 2)

    found = good.withColumn("starts", F.transform("cols", start)).select("doc_id", "page", "top", "bottom", "labels", "starts")
    in_page = Window.partitionBy("doc_id", "page").orderBy("top")
    low = found.withColumn("_n", F.row_number().over(in_page)).where((F.col("_n") == 1) & (F.col("top") > FIRST_HEADER)).drop("_n").withColumns({"top": F.lit(0.0), "bottom": F.lit(0.0)})
    every = found.unionByName(low)
    return every.select("doc_id", "page", (F.row_number().over(in_page) - 1).alias("section"), "top", "bottom", (F.lead("top").over(in_page) - 2).alias("end"), "labels", "starts")


def section_rows(words: DataFrame, page_height: float = float("inf")) -> DataFrame:
    """(doc_id, page, section, band, cells) of statements without borders whose one date column begins each row.

    Band -1 is a section's header; 0 what stands above its first date, kept if it has particulars
    and the section isn't headed by the page's first header; 1 and on the rows, each from its date
    to the next. Sections without dates give nothing. words: lines' columns, with bottom if there is one.
    """
    # what is used again is written, or each use would fold the pages' words anew
    lined = written(lines(words), "lines")
    heads = written(section_headers(lined).withColumn("end", F.coalesce("end", F.lit(page_height))), "sections")
    keys = ["doc_id", "page", "section"]
    # a line with one of the marks has a word that holds its first word
    low = F.lower("text")
    held = reduce(Column.__or__, [F.contains(low, F.lit(m.split(" ")[0])) for m in (SECTION_STOPS, SECTION_SITE, SECTION_SKIP)])
    lines_ = written(lined.where(held).select("doc_id", "page", "line").distinct(), "held")
    told = line_heads(lined.join(small(lines_), ["doc_id", "page", "line"], "left_semi")).select("doc_id", "page", F.col("top").alias("_t"), F.col("bottom").alias("_b"), "raw", "norm")
    marks = F.col("norm").startswith(SECTION_STOPS) | F.contains(F.col("raw"), F.lit(SECTION_SITE)) | F.col("norm").startswith(SECTION_SKIP)
    told = written(told.where(marks).join(heads.select(*keys, "bottom", "end").hint("shuffle_hash"), ["doc_id", "page"]), "marks")
    stop = F.col("norm").startswith(SECTION_STOPS) | F.contains(F.col("raw"), F.lit(SECTION_SITE))
    stops = told.where(stop & (F.col("_t") > F.col("bottom")) & (F.col("_t") < F.col("end"))).groupBy(*keys).agg((F.min("_t") - 2).alias("_stop"))
    heads = heads.join(stops.hint("shuffle_hash"), keys, "left").withColumn("end", F.least("end", F.coalesce("_stop", "end"))).drop("_stop")
    skips = told.drop("end").join(heads.select(*keys, "end").hint("shuffle_hash"), keys).where(F.col("norm").startswith(SECTION_SKIP) & (F.col("_t") >= F.col("bottom")) & (F.col("_t") < F.col("end"))).groupBy(*keys).agg(F.max("_b").alias("_skip"))
    heads = heads.join(skips.hint("shuffle_hash"), keys, "left").withColumn("begin", F.greatest("bottom", F.coalesce("_skip", "bottom"))).drop("_skip")

    heads = written(heads, "sections")
    left = F.get("starts", F.lit(0)) - 2
    body = lined.select("doc_id", "page", "text", "x0", "top").join(heads.select(*keys, F.col("top").alias("_head"), "begin", "end", "labels", "starts").hint("shuffle_hash"), ["doc_id", "page"])
    body = body.where((F.col("top") > F.col("begin")) & (F.col("top") < F.col("end")) & (F.col("x0") >= left))
    anchor = F.when((F.col("x0") < F.get("starts", F.lit(1))) & looks_like_date("text"), F.col("top") - 2)
    marked = body.withColumn("_a", anchor).withColumn("_key", F.coalesce("_a", "top"))
    section = Window.partitionBy(*keys)
    placed = marked.withColumns({"_at": F.max("_a").over(section.orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)), "_any": F.max("_a").over(section)}).where("_any is not null")
    placed = placed.withColumn("band", F.when(F.col("_at").isNull(), 0).otherwise(F.dense_rank().over(section.orderBy("_at")) - F.max(F.col("_at").isNull().cast("int")).over(section)))
    placed = placed.where((F.col("band") > 0) | (F.col("top") >= F.col("begin") + 1))
    placed = placed.withColumns({"column": column_of(F.col("starts"), F.col("x0")), "n": F.size("starts")})
    rows = _cells(placed, [*keys, "band", "labels", "_head"])
    lead = F.get("cells", F.array_position("labels", F.lit("Particulars")).cast("int") - 1) != ""
    rows = rows.where((F.col("band") > 0) | (lead & ((F.col("section") > 0) | (F.col("_head") == 0))))
    named = rows.select(*keys).distinct().join(heads.select(*keys, F.lit(-1).alias("band"), F.col("labels").alias("cells")).hint("shuffle_hash"), keys)
    return named.unionByName(rows.select(*keys, "band", "cells"))


def rectangle_rows(words: DataFrame, rects: DataFrame, header: DataFrame, pages: DataFrame | float = 600.0) -> DataFrame:
    """(doc_id, page, top, cells) of shaded rectangles(doc_id, page, x0, x1, top, bottom) that are rows.

    A row's rectangle takes 65 % of the page's width (pages(doc_id, page, width), or one for all), covers the
    columns, is 10 to 120 high and below the header; it stays if its serial (or first cell) is a
    number and its date (or second cell) looks like one. An interval join within a page.
    """
    starts = F.col("starts")
    own = rects.select("doc_id", "page", F.col("x0").alias("r_x0"), F.col("x1").alias("r_x1"), F.col("top").alias("r_top"), F.col("bottom").alias("r_bottom")).distinct()
    own = own.join(pages.select("doc_id", "page", F.col("width").alias("_width")), ["doc_id", "page"]) if isinstance(pages, DataFrame) else own.withColumn("_width", F.lit(pages))
    bands = own.join(header.select("doc_id", "page", "labels", "starts", F.coalesce("top", F.lit(float("-inf"))).alias("_head")).hint("shuffle_hash"), ["doc_id", "page"]).where(
        ((F.col("r_x1") - F.col("r_x0")) >= 0.65 * F.col("_width")) & (F.col("r_x0") <= F.get(starts, F.lit(0)) + 10) & (F.col("r_x1") >= F.get(starts, F.size(starts) - 1) + 20) & (F.col("r_bottom") - F.col("r_top")).between(10, 120) & (F.col("r_top") > F.col("_head"))
    )
    bands = bands.select("doc_id", "page", "r_top", "r_bottom", "starts", "labels").dropDuplicates(["doc_id", "page", "r_top", "r_bottom"])
    inside = words.join(bands.hint("shuffle_hash"), ["doc_id", "page"]).where((F.col("top") >= F.col("r_top") - 1) & (F.col("top") < F.col("r_bottom") + 1))
    rows = _cells(inside.withColumn("column", column_of(starts, F.col("x0"))).withColumn("n", F.size(starts)), ["doc_id", "page", "r_top", "labels"])
    at = lambda label, other: F.get("cells", F.coalesce(F.nullif(F.array_position("labels", F.lit(label)).cast("int"), F.lit(0)) - 1, F.lit(other)))
    return rows.where(at("SlNo", 0).rlike(r"^\d+$") & looks_like_date(at("Transaction Date", 1))).select("doc_id", "page", F.col("r_top").alias("top"), "cells")


def recognised_rows(words: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, line, cells): one row for each line below a page's header, in its columns, with the header as line 0.

    Pages without a header have the rows of their text in texts(doc_id, page, text), if it is given.
    """
    lined = lines(words)
    head = headers(lined)
    below = lined.join(head.select("doc_id", "page", "starts", F.col("line").alias("_h")).hint("shuffle_hash"), ["doc_id", "page"]).where("line > _h")
    rows = _cells(below.withColumn("column", column_of(F.col("starts"), F.col("x0"))).withColumn("n", F.size("starts")), ["doc_id", "page", "line"])
    out = head.select("doc_id", "page", F.lit(0).alias("line"), F.col("labels").alias("cells")).unionByName(rows)
    if texts is None:
        return out
    plain = text_rows(texts.join(head.select("doc_id", "page").hint("shuffle_hash"), ["doc_id", "page"], "left_anti"), "doc_id", "page")
    return out.unionByName(plain.select("doc_id", "page", F.col("row_number").alias("line"), "cells"))


def recognised_text(words: DataFrame) -> DataFrame:
    """words(doc_id, page, line, text, x0, top, confidence): (doc_id, page, text, confidence), lines in order of their first word.

    confidence is the mean of those that are not negative, 0 if there is none.
    """
    ws = F.array_sort(F.collect_list(F.struct("x0", "text")))
    per = words.where(strip("text") != "").groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("t"), F.min(F.struct("top", "x0")).alias("at"))
    text = per.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n").alias("text"))
    sure = words.groupBy("doc_id", "page").agg(F.coalesce(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
    return text.join(sure.hint("shuffle_hash"), ["doc_id", "page"])


def projected(rows: DataFrame, target: DataFrame) -> DataFrame:
    """rows(doc_id, labels, cells) on their document's target(doc_id, labels): cells by label, '' where a row has none."""
    want = target.select("doc_id", F.col("labels").alias("_want"))
    at = lambda label: F.coalesce(F.get("cells", F.array_position("labels", label).cast("int") - 1), F.lit(""))
    return rows.join(want, "doc_id").withColumn("cells", F.transform("_want", at)).withColumn("labels", F.col("_want")).drop("_want")


def first_headers(found: DataFrame) -> DataFrame:
    """(doc_id, labels) of each document's first header."""
    return found.groupBy("doc_id").agg(F.min_by("labels", "page").alias("labels"))


def preferred(rows: DataFrame) -> DataFrame:
    """Of rows(doc_id, page, source_rank, ...) those of each page's best source: serial, then date, tables, rectangles."""
    best = F.min("source_rank").over(Window.partitionBy("doc_id", "page"))
    return rows.withColumn("_best", best).where("source_rank = _best").drop("_best")
