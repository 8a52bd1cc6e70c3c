"""Ordered labels of a lookup result, as an array of structs; nulls filtered, order kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .settings import DEFAULTS, label_switches

#: Switches and their defaults, by the key of the label.
SETTINGS = label_switches(DEFAULTS)
#: Ranks that are shown, with their text and style.
CORE_LABELS = {"A*": ("A*", "astar"), "A": ("A", "a"), "B": ("B", "b"), "C": ("C", "c"), "Australasian A": ("澳新A", "aus"), "Australasian B": ("澳新B", "aus"), "Australasian C": ("澳新C", "aus")}
KIND = "struct<key:string,text:string,cls:string,title:string>"


def _label(key, text, cls, title) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(key).alias("key"), as_col(text).alias("text"), as_col(cls).alias("cls"), as_col(title).alias("title"))


def labels(settings: dict | None = None) -> Column:
    """Array of labels for a row of lookup()."""
    on = SETTINGS | (settings or {})
    # Texts, styles and titles of the labels below.
    c, k, j = F.col, F.concat, "journal."
    shown = lambda name, cond, label: F.when(cond, label) if on[name] else F.lit(None).cast(KIND)
    ccf = _label("ccf", k(F.lit("CCF "), c("ccf.rank")), k(F.lit("sr-ccf sr-ccf-"), F.lower("ccf.rank")), k(F.lit("CCF "), c("ccf.rank"), F.when(c("ccf.type") == "journal", " 类期刊\n").otherwise(" 类会议\n"), F.coalesce("ccf.abbr", F.lit("")), F.lit(" — "), c("ccf.name"), F.lit("\n领域："), F.coalesce("ccf.field", F.lit(""))))
    names = F.create_map(*[F.lit(x) for a, (b, _) in CORE_LABELS.items() for x in (a, b)])
    slugs = F.create_map(*[F.lit(x) for a, (_, b) in CORE_LABELS.items() for x in (a, b)])
    core_title = k(F.lit("CORE "), c("core.rank"), F.lit("（"), F.coalesce(F.nullif(c("core.source"), F.lit("")), F.lit("CORE")), F.lit("）\n"), F.coalesce("core.abbr", F.lit("")), F.lit(" — "), c("core.name"), F.when(F.coalesce("core.field", F.lit("")) != "", k(F.lit("\n领域："), c("core.field"))).otherwise(""))
    core = _label("core", k(F.lit("CORE "), F.try_element_at(names, c("core.rank"))), k(F.lit("sr-core sr-core-"), F.try_element_at(slugs, c("core.rank"))), core_title)
    has_cat = c(j + "cat").isNotNull()
    sub = F.when(c(j + "sub").isNotNull(), k(F.lit("\n小类："), c(j + "sub"), F.lit(" "), c(j + "sub_zone").cast("string"), F.lit("区"))).otherwise("")
    cas = _label("cas", k(F.lit("SCI升级版 "), c(j + "cat"), c(j + "zone").cast("string"), F.lit("区")), k(F.lit("sr-cas sr-zone-"), c(j + "zone").cast("string")), k(F.lit("中科院分区表升级版 2025\n大类："), c(j + "cat"), F.lit(" "), c(j + "zone").cast("string"), F.lit("区"), sub, F.lit("\n收录："), F.coalesce(j + "wos", F.lit("—"))))
    number = F.expr(T.number_text("journal.impact"))
    rest = F.array(
        shown("ccf", c("ccf").isNotNull(), ccf),
        shown("core", c("core").isNotNull() & c("core.rank").isin(list(CORE_LABELS)), core),
        shown("top", (c(j + "top") == 1) & has_cat, _label("top", k(c(j + "cat"), F.lit("TOP")), "sr-top", k(F.lit("中科院分区表升级版："), c(j + "cat"), F.lit(" TOP 期刊")))),
        shown("ei", c(j + "ei") == 1, _label("ei", "EI检索", "sr-ei", "EI Compendex 收录（目录版本见设置页）")),
        shown("cas", c(j + "zone").isNotNull() & has_cat, cas),
        shown("jcr", c(j + "quartile").isNotNull(), _label("jcr", k(F.lit("JCR "), c(j + "quartile")), k(F.lit("sr-jcr sr-"), F.lower(j + "quartile")), k(F.lit("JCR 2025 分区 "), c(j + "quartile")))),
        shown("if", c(j + "impact").isNotNull(), _label("if", k(F.lit("IF "), number), "sr-if", k(F.lit("JCR 2025 影响因子 "), number))),
        shown("warn", c(j + "warn").isNotNull(), _label("warn", k(F.lit("预警 "), c(j + "warn")), "sr-warn", k(F.lit("国际期刊预警名单 2025："), c(j + "warn")))),
    )
    none = F.array().cast(f"array<{KIND}>")
    tag = lambda t: _label(F.concat(F.lit("tag:"), t["id"]), t["label"], F.concat(F.lit("sr-tag "), t["cls"]), F.when(t["descr"] != "", F.concat(t["label"], F.lit("\n"), t["descr"])).otherwise(t["label"]))
    tags = F.coalesce(F.transform("tags", tag), none) if on["tags"] else none
    normal = F.filter(F.concat(tags, rest), lambda x: x.isNotNull())
    if on["unmatched"]:
        normal = F.when(F.size(normal) == 0, F.array(_label("unmatched", "未收录", "sr-none", "未收录"))).otherwise(normal)
    server = F.coalesce("preprint_name", F.lit(T.NO_SERVER))
    preprint = F.array(_label("preprint", server, "sr-preprint", k(F.lit("预印本（"), server, F.lit("）\n未经同行评审，不参与分级")))) if on["preprint"] else none
    return F.when(c("kind") == "preprint", preprint).when(c("kind") == "normal", normal).otherwise(none)


def first_with_labels(rows: DataFrame) -> DataFrame:
    """line_id, pos, labels -> the labels of the first candidate of a line that has any."""
    return rows.where(F.size("labels") > 0).groupBy("line_id").agg(F.min_by("labels", "pos").alias("labels"), F.min("pos").alias("pos"))


def explain(found: DataFrame) -> DataFrame:
    """raw, kind, matched_name, via, core_via and the label texts joined by blanks."""
    return found.select("raw", "kind", "matched_name", "via", "core_via", F.array_join(F.transform(labels(), lambda x: x["text"]), " ").alias("labels"))
