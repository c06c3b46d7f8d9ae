"""Line formats as column expressions: sections, delimited lines, resource strings, forms, markers, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def sections(rows: DataFrame, text_col: str, sentinel: str = "@@") -> DataFrame:
    """(row's other columns, section, place, line) of a text whose sections begin with ``sentinel`` and a name.

    Lines before the first are of the section ``_``. A section's lines are those up to the next sentinel; no window over
    lines is needed, as the text is split at the sentinels first.
    """
    others = [c for c in rows.columns if c != text_col]
    blocks = F.split(F.concat(F.lit(f"\n{sentinel}_\n"), F.coalesce(F.col(text_col), F.lit(""))), f"\r?\n{sentinel}")
    opened = rows.select(*others, F.posexplode(F.slice(blocks, 2, F.size(blocks))).alias("block", "body"))
    split = opened.select(*others, "block", F.trim(F.regexp_extract("body", r"^([^\n]*)", 1)).alias("section"), F.posexplode(lines(F.regexp_replace("body", r"^[^\n]*\n?", ""))).alias("place", "line"))
    return split.drop("block")


def piped(line: Column, n: int) -> Column:
    """Trimmed cells of a line between bars, filled up to ``n``; null for a line without a first cell."""
    cells = F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
    filled = F.concat(cells, F.array_repeat(F.lit(""), n))
    return F.when(F.get(cells, 0) != "", F.slice(filled, 1, F.greatest(F.size(cells), F.lit(n))))


def after(line: Column, key: str) -> Column:
    """The value of ``key=value`` in a line of such words."""
    return F.regexp_extract(line, rf"(?:^|\s){key}=(\S*)", 1)


def megabytes(text: Column) -> Column:
    """Whole megabytes of a size, a bare number being megabytes; 0 for anything else."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*[KMGT]?B?$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^\d+(?:\.\d+)?\s*([KMGT]?)B?$", 1)
    factor = F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1024.0 * 1024).otherwise(1.0)
    return F.coalesce(F.floor(number * factor).cast("long"), F.lit(0).cast("long"))


def resources(text: Column) -> Column:
    """Map of ``cpu=64,mem=1000G,gres/gpu:h100=4``: counts, memory in megabytes."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.rlike(r"^[^=]+=.+$") & ~p.endswith("=N/A"))
    key, value = (lambda p: F.substring_index(p, "=", 1)), (lambda p: F.regexp_replace(p, "^[^=]*=", ""))
    count = lambda p: F.when(key(p) == "mem", megabytes(value(p))).otherwise(F.coalesce(F.regexp_replace(value(p), r"\D", "").try_cast("long"), F.lit(0).cast("long")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p), count(p))))


def gpus(text: Column) -> Column:
    """(type, n) of each device entry of ``gpu:h100:4(S:0-1),gpu:2``; devices without a model are ``untyped``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|,)\s*(gpu:(?:[A-Za-z0-9_.-]+:)?\d+)"), F.lit(1))
    kind = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^gpu:([A-Za-z0-9_.-]+):\d+$", 1), F.lit("")), F.lit("untyped"))
    return F.transform(found, lambda x: F.struct(kind(x).alias("type"), F.regexp_extract(x, r"(\d+)$", 1).cast("long").alias("n")))


def gpu_total(text: Column) -> Column:
    """Devices of all entries; null without one."""
    found = gpus(text)
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["n"]))


def inventory(tres: Column) -> Column:
    """(type, n) of a partition's resource string; the untyped total only where no type is named."""
    typed = F.regexp_extract_all(tres, F.lit(r"gres/gpu:[A-Za-z0-9_.-]+=\d+"), F.lit(0))
    bare = F.regexp_extract(tres, r"gres/gpu=(\d+)", 1).try_cast("long")
    named = F.transform(typed, lambda x: F.struct(F.regexp_extract(x, r"gpu:([A-Za-z0-9_.-]+)=", 1).alias("type"), F.regexp_extract(x, r"(\d+)$", 1).cast("long").alias("n")))
    return F.when(F.size(typed) > 0, named).when(bare > 0, F.array(F.struct(F.lit("untyped").alias("type"), bare.alias("n")))).otherwise(F.array().cast("array<struct<type:string,n:bigint>>"))


def node(line: Column) -> Column:
    """A node's line: name, state, reason, devices, and configured and allocated resources."""
    reason = F.trim(F.regexp_extract(line, r"\sReason=(.*?)(?:\s\[\S+@[^\]]*\]|\s\w+=|$)", 1))
    return F.when(
        line.rlike(r"NodeName=\S+"),
        F.struct(after(line, "NodeName").alias("name"), after(line, "State").alias("state"), reason.alias("reason"), after(line, "Gres").alias("gres"), after(line, "GresUsed").alias("gres_used"), resources(after(line, "CfgTRES")).alias("cfg"), resources(after(line, "AllocTRES")).alias("alloc")),
    )


def quota(line: Column) -> Column:
    """A row of a quota table; null for rulers, headings and anything that is no upper-case space."""
    c = piped(line, 7)
    names = ["space", "used_gb", "limit_gb", "pct_space", "files", "file_limit", "pct_files"]
    return F.when(F.get(c, 0).rlike("^[A-Z][A-Z0-9 ]*$") & (F.size(F.split(line, r"\|")) >= 7), F.struct(*[F.get(c, k).alias(n) for k, n in enumerate(names)]))


def devices(text: Column) -> Column:
    """One entry per device line, its id if it has one."""
    found = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x.rlike(r"^GPU\s+\d+:"))
    return F.transform(found, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"UUID:\s*((?:GPU|MIG)-[0-9a-fA-F-]+)", 1), F.lit("")), x))


def processes(text: Column) -> Column:
    """(pid, gpu, name) of lines ``pid, gpu, name``; others are left out."""
    found = F.filter(lines(text), lambda x: x.rlike(r"^\s*\d+\s*,"))
    cell = lambda x, k: F.trim(F.coalesce(F.get(F.split(x, ",", 3), k), F.lit("")))
    return F.transform(found, lambda x: F.struct(cell(x, 0).cast("long").alias("pid"), cell(x, 1).alias("gpu"), cell(x, 2).alias("name")))


def visible(text: Column) -> Column:
    """Number of devices that are listed; 0 for none, null if unset."""
    t = F.trim(text)
    return F.when(t.isin("", "NoDevFiles", "-1"), 0).otherwise(F.size(F.filter(F.split(t, ","), lambda x: F.trim(x) != ""))).cast("int")


def allocated(on_node: Column, listed: Column) -> Column:
    """Allocated devices, from a count at the end of one variable, else from a list in another; else null."""
    count = F.regexp_extract(F.trim(F.coalesce(on_node, F.lit(""))), r"(\d+)\s*$", 1).try_cast("int")
    return F.coalesce(count, F.when(F.trim(F.coalesce(listed, F.lit(""))) != "", visible(listed)))


def form(body: Column) -> Column:
    """Map of an issue form's labels, in lower case, to their text; ``_No response_`` is empty."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(body, F.lit(""))), r"\n### "), lambda p: F.trim(p) != "")
    label = lambda p: F.lower(F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)))
    value = lambda p: F.trim(F.regexp_replace(p, r"^[^\n]*\n?", ""), F.lit(" \n\r\t"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(label(p), F.when(value(p) == "_No response_", "").otherwise(value(p)))))


def tokens_of(text: Column, keys: list[str]) -> Column:
    """Map of ``key=value`` and ``key: value`` tokens for the keys; the first value of a key stands."""
    rx = rf"(?i)\b({'|'.join(keys)})\s*[=:]\s*([^\s,;]+)"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("v"))
    first = lambda k: F.element_at(F.filter(found, lambda x: F.lower(x["k"]) == k), 1)
    held = F.array_distinct(F.transform(found, lambda x: F.lower(x["k"])))
    return F.map_from_entries(F.transform(held, lambda k: F.struct(k, first(k)["v"])))


LINK = r"^\s*([a-z][a-z-]*)\s*:\s*([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+|kg:[A-Za-z0-9_.:/-]+)\s*$"


def links(body: Column) -> Column:
    """(line, edge, target) of every line of the ``links`` blocks but blanks and comments; edge is null if it can't be read."""
    blocks = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)```links\s*\n(.*?)```"), F.lit(1))
    held = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    part = lambda x, k: F.nullif(F.regexp_extract(x, LINK, k), F.lit(""))
    return F.transform(held, lambda x: F.struct(F.trim(x).alias("line"), part(x, 1).alias("edge"), part(x, 2).alias("target")))


SESSION = r"<!-- session id=([A-Za-z0-9._-]+) user=([A-Za-z0-9-]+) beat=([0-9T:+-]+Z)(?: job=(\d+))?(?: item=(\S+#\d+))? -->"


def session(body: Column) -> Column:
    """The first session marker of a comment."""
    part = lambda k: F.nullif(F.regexp_extract(body, SESSION, k), F.lit(""))
    return F.when(body.rlike(SESSION), F.struct(part(1).alias("session"), part(2).alias("user"), F.try_to_timestamp(part(3)).alias("beat"), part(4).alias("job"), part(5).alias("item")))


LEASE = r"<!-- lease user=([A-Za-z0-9-]+) until=([0-9T:+-]+Z) -->"


def own_leases(body: Column, author: Column) -> Column:
    """(user, until) of a comment's lease markers that its author posted for themselves."""
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(LEASE), F.lit(1)).alias("user"), F.regexp_extract_all(body, F.lit(LEASE), F.lit(2)).alias("until"))
    return F.filter(found, lambda x: F.lower(x["user"]) == F.lower(F.coalesce(author, F.lit(""))))


# Kinds of contribution, in order.
KINDS = ["report", "request", "fix", "review", "comment", "mention"]


def contributions(text: Column) -> Column:
    """(login, kinds) of ``login: fix, review; other: comment``; unknown kinds are left out."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(F.substring_index(p, ":", 1)) != "")
    login = lambda p: F.lower(F.regexp_replace(F.trim(F.substring_index(p, ":", 1)), "^@+", ""))
    kinds = lambda p: F.filter(F.transform(F.split(F.regexp_replace(p, "^[^:]*:?", ""), ","), lambda k: F.trim(k)), lambda k: k.isin(*KINDS))
    return F.transform(parts, lambda p: F.struct(login(p).alias("login"), kinds(p).alias("kinds")))


def contribution_text(by: Column) -> Column:
    """The text of (login, kinds), logins in order, kinds in their fixed order; logins without a kind are left out."""
    order = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(by, lambda x: F.struct(F.lower(x["login"]).alias("k"), x["login"].alias("login"), F.filter(order, lambda k: F.array_contains(x["kinds"], k)).alias("kinds")))
    return F.array_join(F.transform(F.array_sort(F.filter(shown, lambda x: F.size(x["kinds"]) > 0)), lambda x: F.concat(x["login"], F.lit(": "), F.array_join(x["kinds"], ", "))), "; ")


def markdown_row(*cells: Column, width: int = 60) -> Column:
    """Cells between bars, bars and line breaks in them made harmless, cut to ``width`` characters."""
    plain = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ") for c in cells]
    cut = [F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c) for c in plain]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cut), F.lit(" |"))


def markdown_cells(line: Column) -> Column:
    """Trimmed cells of a table's row; null for rulers and other lines."""
    t = F.trim(line)
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace(t, r"^\|", ""), r"\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(t.startswith("|") & ~F.forall(cells, lambda c: c.rlike("^[-: ]*$")), cells)
