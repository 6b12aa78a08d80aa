"""URL frontier, link graph, crawl bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.functions.binding import with_once
from gleaner.functions.records import path_column
from gleaner.functions.text import java_groups
from gleaner.plans.ranking import running_total, running_totals, top_per_key
from gleaner.session import pin


def url_frontier(
    items: DataFrame,
    config: Mapping[str, Any],
    base_url: Column,
    origin_url: Column,
    seq: str = "_seq",
) -> DataFrame:
    """Canonical, filtered, first-wins frontier with stable record ids.

    Config keys: ``url_path``, ``frontier_title_patterns``, ``frontier_title_path``,
    ``drop_query_params``, ``allowed_domains``, ``same_origin_only``, ``url_pattern``,
    ``limit``.  Python-style named groups of the pattern become columns.
    """
    import re

    raw = path_column(items, str(config.get("url_path") or "url")).cast("string")
    rows = items
    patterns = [str(p) for p in config.get("frontier_title_patterns") or [] if str(p)]
    if patterns:
        title = F.coalesce(path_column(items, str(config.get("frontier_title_path") or "title")), F.lit(""))
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | title.rlike(f"(?iu){pattern}")
        rows = rows.where((title != "") & hit)
    rows = rows.where(raw.isNotNull() & (raw != ""))
    absolute = urls.resolve(base_url, raw)
    rows = with_once(rows, "canonical", urls.canonical_url(absolute, config.get("drop_query_params") or []))
    rows = rows.withColumns({"__origin": urls.host(origin_url), "__host": urls.host(F.col("canonical"))}).where(
        F.col("canonical").rlike("^https?:")
    )
    domains = [str(d).strip().lower().split(":", 1)[0] for d in config.get("allowed_domains") or [] if str(d).strip()]
    if domains:
        rows = rows.where(urls.within_domains(F.col("__host"), domains))
    elif config.get("same_origin_only", True):
        rows = rows.where((F.col("__origin") == "") | (F.col("__host") == F.col("__origin")))
    pattern = str(config.get("url_pattern") or "").strip()
    java = "(?iu)" + java_groups(pattern)
    if pattern:
        rows = rows.where(F.col("canonical").rlike(java))
    first = top_per_key(rows, ["canonical"], [F.col(seq)])
    given = path_column(items, "record_id").cast("string") if "record_id" in items.columns else F.lit(None).cast("string")
    match_id = F.lit(None).cast("string")
    named: dict[str, Column] = {}
    if pattern:
        compiled = re.compile(pattern, re.I)
        match_id = F.regexp_extract(F.col("canonical"), java, 1 if compiled.groups else 0)
        for name, index in compiled.groupindex.items():
            value = F.regexp_extract(F.col("canonical"), java, index)
            named[name] = F.when(value != "", value)
    out = first.withColumns({**named, "record_id": F.coalesce(given, F.when(match_id != "", match_id), urls.short_id(F.col("canonical")))})
    out = out.drop("__origin", "__host")
    limit = config.get("limit")
    return out.orderBy(seq).limit(int(limit)) if limit else out


def merge_parent_child(parents: DataFrame, children: DataFrame, key: str, mode: str = "MERGE_PARENT_CHILD") -> DataFrame:
    """List and detail rows joined on the canonical url; child fields win when merging."""
    if mode == "PARENT_ONLY":
        return parents.join(children.select(key), key)
    if mode == "CHILD_ONLY":
        return parents.select(key).join(children, key)
    p, c = parents.alias("p"), children.alias("c")
    joined = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"))
    names = [n for n in parents.columns if n != key] + [n for n in children.columns if n != key and n not in parents.columns]
    columns = [F.col(f"p.{key}").alias(key)]
    for name in names:
        columns.append((F.col(f"c.{name}") if name in children.columns else F.col(f"p.{name}")).alias(name))
    return joined.select(*columns)


def fanout_split(joined: DataFrame, succeeded: Column, policy: str = "CONTINUE", minimum: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, errors, verdict)``; the verdict row says whether the policy holds."""
    ok = F.coalesce(succeeded, F.lit(False))
    counts = joined.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    verdict = {
        "FAIL_FAST": F.col("failed") == 0,
        "REQUIRE_MINIMUM": F.col("succeeded") >= minimum,
    }.get(policy, F.lit(True))
    counts = counts.withColumns(
        {"accepted": verdict, "partial": (F.col("failed") > 0) & (F.col("succeeded") > 0)}
    )
    return joined.where(ok), joined.where(~ok), counts


def crawl_closure(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int | None = None,
    max_items: int | None = None,
    node: str = "url",
    source: str = "src",
    target: str = "dst",
) -> DataFrame:
    """Breadth-first closure ``(url, depth, truncated)``.

    Without ``max_depth`` it ends when a level finds nothing new.  With it, or with
    ``max_items``, ``truncated`` marks addresses whose links may lead to addresses left out.
    Each level keeps only unseen addresses and is pinned, so the plan stays one
    level long and a lost executor re-reads a checkpoint.  Links are reduced to
    distinct edges and pinned once, not once per level; the frontier side of the join is unique, so a hub page
    skews only the streamed side, which adaptive execution splits.
    """
    # Distributed by source once, as every level joins on it.
    edges = pin(links.select(F.col(source), F.col(target)).distinct().repartition(source))
    level = pin(seeds.select(F.col(node)).distinct().withColumn("depth", F.lit(1)))
    visited = level
    depth, cut = 1, False
    while True:
        depth += 1
        found = (
            edges.join(level.select(F.col(node).alias(source)), source)
            .select(F.col(target).alias(node))
            .distinct()
            .join(visited.select(node), node, "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if max_depth is not None and depth > max_depth:
            cut = not found.isEmpty()
            break
        level = pin(found)
        new = level.count()
        if not new:
            break
        if max_items is not None:
            # An asked-for crawl budget: earlier levels first, then address order.
            room = max(max_items - visited.count(), 0)
            if new > room:
                visited = visited.unionByName(level.orderBy(node).limit(room)) if room else visited
                cut = True
                break
        visited = visited.unionByName(level)
    if not cut:
        return visited.withColumn("truncated", F.lit(False))
    left_out = edges.join(visited.select(F.col(node).alias(target)), target, "left_anti").select(F.col(source).alias(node)).distinct()
    flags = left_out.withColumn("truncated", F.lit(True))
    return visited.join(flags, node, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def resume_sets(attempted: DataFrame, errors: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """``(completed, retry)``: everything attempted without, and with, an error."""
    failed = errors.select(url).distinct()
    return attempted.join(failed, url, "left_anti"), attempted.join(failed, url, "left_semi")


def not_completed(frontier: DataFrame, checkpoint: DataFrame, url: str = "url") -> DataFrame:
    return frontier.join(checkpoint.select(url), url, "left_anti")


def advance_checkpoint(checkpoint: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    return checkpoint.select(url).unionByName(visited.select(url)).distinct()


def _first_seen(rows: DataFrame, value: Column, seq: str, name: str) -> DataFrame:
    """The first place of each row's value; a null value is its own first.

    First places are pre-aggregated, so a group of copies of any size is only ever a minimum.
    """
    marked = rows.withColumn("__signature", value)
    # Rows without a value repeat nothing; they stay out of the join, where one key
    # would take them all.
    signed, unsigned = marked.where(F.col("__signature").isNotNull()), marked.where(F.col("__signature").isNull())
    firsts = signed.groupBy("__signature").agg(F.min(seq).alias(name))
    return signed.join(firsts, "__signature").unionByName(unsigned.withColumn(name, F.col(seq))).drop("__signature")


def repeated_pages(pages: DataFrame, signature: Column, seq: str, address: Column | None = None) -> DataFrame:
    """Pages whose text signature, or canonical ``address`` if given, was seen before."""
    found = _first_seen(pages, signature, seq, "first_seen")
    repeated = F.col(seq) > F.col("first_seen")
    if address is not None:
        found = _first_seen(found, urls.canonical_url(address), seq, "first_address")
        repeated = repeated | (F.col(seq) > F.col("first_address"))
    return found.withColumn("repeated", repeated)


def reconciliation(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """Discovered, succeeded, skipped, failed and duplicate counts in one pass."""
    state = F.col(status)
    return outcomes.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(state == "SUCCEEDED").alias("succeeded"),
        F.count_if(state == "SKIPPED").alias("intentionally_skipped"),
        F.count_if(state == "FAILED").alias("failed"),
        F.count_if(state == "DUPLICATE").alias("duplicate"),
    )


def date_boundary(
    df: DataFrame,
    time: str,
    lower: str | None,
    upper: str | None,
    order: str = "",
    stop_when_older: bool = False,
    seq: str = "_seq",
) -> tuple[DataFrame, DataFrame]:
    """``[lower, upper)`` rows and one diagnostics row.

    Early stop happens only for a declared order: rows after the first one past the
    boundary are dropped.  The stop position is a single minimum, not a running scan.
    """
    value = F.col(time)
    lo = F.lit(lower).cast("timestamp_ntz") if lower else None
    hi = F.lit(upper).cast("timestamp_ntz") if upper else None
    inside = value.isNotNull()
    if lo is not None:
        inside = inside & (value >= lo)
    if hi is not None:
        inside = inside & (value < hi)
    proven = order.upper() in ("ASC", "DESC")
    past = F.lit(False)
    if proven and stop_when_older and lo is not None:
        past = value < lo if order.upper() == "DESC" else (value >= hi if hi is not None else F.lit(False))
    stop = df.agg(F.min(F.when(past, F.col(seq))).alias("__stop"))
    # One aggregated row, so this broadcast is bounded.
    rows = df.join(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col(seq) <= F.col("__stop")))
    diagnostics = rows.agg(
        F.max_by(time, F.when(value.isNotNull(), F.col(seq))).alias("last_seen"),
        F.max("__stop").alias("stop_position"),
        F.count_if(inside).alias("selected"),
    ).select(
        "last_seen",
        F.lit(proven).alias("ordering_proven"),
        F.when(F.col("stop_position").isNotNull(), "DATE_BOUNDARY_REACHED").alias("stop_reason"),
        "selected",
    )
    return rows.where(inside).drop("__stop"), diagnostics


def lookback_bounds(clock: Column, days: int, zone: str, pattern: str = "YYYY-MM-DD") -> tuple[Column, Column]:
    """Formatted local-day bounds ``clock - days .. clock``."""
    from gleaner.functions.dates import format_date, to_local

    local = to_local(clock, zone)
    return format_date(local - F.make_dt_interval(days=F.lit(days)), pattern), format_date(local, pattern)


def lookback_window(df: DataFrame, time: str, clock: Column, days: int, zone: str) -> DataFrame:
    """Rows whose local day is within ``days`` before the clock's local day."""
    from gleaner.functions.dates import to_local

    today = to_local(clock, zone).cast("date")
    day = to_local(F.col(time), zone).cast("date")
    return df.where(day.between(F.date_sub(today, days), today))


# What a run may use up, in the order of checking, with the code of each.
BUDGETS = {
    "deadline": "BUDGET_DEADLINE_EXCEEDED",
    "requests": "BUDGET_MAX_REQUESTS_EXCEEDED",
    "bytes": "BUDGET_MAX_BYTES_EXCEEDED",
    "pages": "BUDGET_MAX_PAGES_EXCEEDED",
    "items": "BUDGET_MAX_ITEMS_EXCEEDED",
}


def budgeted(df: DataFrame, limits: Mapping[str, float], uses: Mapping[str, Column], seq: str = "_seq") -> DataFrame:
    """Rows with what the run has used up to them (``used_…``) and ``cut``, the code of the first budget beyond its limit.

    ``limits`` names budgets of ``BUDGETS``; ``uses`` gives a row's share of each, negative and null ones as
    none.  The deadline's use is the time since the start at that row, which ascends with ``seq``.  All totals
    are sums of one range pass.  A total never falls, so a row is within the budgets just when its own ``cut`` is null.
    """
    unknown = (set(limits) | set(uses)) - set(BUDGETS)
    if unknown or set(limits) - set(uses):
        raise ValueError(f"no such budget, or nothing that uses it: {sorted(unknown or set(limits) - set(uses))}")
    share = {f"used_{n}": F.greatest(F.coalesce(u, F.lit(0)), F.lit(0)) for n, u in uses.items() if n != "deadline"}
    rows = running_totals(df, [seq], share) if share else df
    if "deadline" in uses:
        rows = rows.withColumn("used_deadline", uses["deadline"])
    cut = F.lit(None).cast("string")
    for name in reversed([n for n in BUDGETS if n in limits]):
        cut = F.when(F.col(f"used_{name}") > F.lit(limits[name]), BUDGETS[name]).otherwise(cut)
    return rows.withColumn("cut", cut)


def budget_report(rows: DataFrame, seq: str = "_seq") -> DataFrame:
    """One row about ``budgeted`` rows: why and where the run was cut, rows kept, and what those used."""
    used = [c for c in rows.columns if c.startswith("used_")]
    within = F.col("cut").isNull()
    return rows.agg(
        F.min_by("cut", F.when(~within, F.col(seq))).alias("reason"),
        F.min(F.when(~within, F.col(seq))).alias("cut_at"),
        F.count_if(within).alias("kept"),
        *[F.max(F.when(within, F.col(c))).alias(c) for c in used],
    )


def budget_cutoff(
    df: DataFrame,
    seq: str = "_seq",
    max_items: int | None = None,
    max_bytes: int | None = None,
    size: str | None = None,
    max_depth: int | None = None,
    depth: str = "depth",
) -> DataFrame:
    """Rows a run may still process, in ``seq`` order.

    Item budgets are a top-k.  The byte budget is a running total over ranges; the
    row that crosses it and everything after are out.
    """
    rows = df
    if max_depth is not None:
        rows = rows.where(F.col(depth) <= max_depth)
    if max_items is not None:
        rows = rows.orderBy(seq).limit(max_items)
    if max_bytes is not None and size is not None:
        rows = running_total(rows, [seq], F.greatest(F.col(size), F.lit(0)), "__bytes")
        rows = rows.where(F.col("__bytes") <= max_bytes).drop("__bytes")
    return rows


def url_policy(
    table: DataFrame,
    url: str = "url",
    address: str | None = None,
    domains: Sequence[str] = (),
    ports: Sequence[int] = (80, 443),
) -> DataFrame:
    """Outbound audit of a url table: the first broken rule, null when allowed."""
    value = F.col(url)
    listed = [d.lower().lstrip(".") for d in domains if d.strip()]
    reason = F.when(~urls.scheme(value).isin("http", "https"), "SCHEME")
    reason = reason.when((urls.host(value) == "") | urls.netloc(value).contains("@"), "HOST")
    reason = reason.when(~F.coalesce(urls.port(value).isin(*ports), F.lit(False)), "PORT")
    if listed:
        reason = reason.when(~urls.within_domains(F.regexp_replace(urls.host(value), "[.]+$", ""), listed), "DOMAIN")
    if address:
        reason = reason.when(F.col(address).isNull() | (F.col(address) == ""), "UNRESOLVED")
        reason = reason.when(~urls.public_ipv4(F.col(address)), "ADDRESS")
    return table.withColumn("violation", reason)


def attach_related(
    records: DataFrame,
    documents: DataFrame,
    attachments: str = "attachments",
    url: str = "url",
    max_files: int | None = None,
    extensions: Sequence[str] = (".xlsx", ".xls", ".csv", ".pdf", ".docx"),
    key: str = "page_id",
    page: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Parsed documents of listed attachments: ``(attached, misses)``.

    Attachments are addresses; with ``page``, a column of the records, relative ones are resolved
    against it.

    ``documents(url, ...)`` is keyed by canonical address.  ``max_files`` allows that many
    attachments of a listed extension per record; those beyond it are among the misses, with
    ``left_out`` set.
    """
    listed = records.select(key, *([F.col(page).alias("__page")] if page else []), F.posexplode(attachments).alias("position", "__raw"))
    whole = urls.resolve(F.col("__page"), F.col("__raw")) if page else F.col("__raw")
    listed = with_once(listed, url, urls.canonical_url(whole)).select(key, "position", url)
    wanted = listed.where(urls.file_suffix(F.col(url)).isin(*[e.lower() for e in extensions]))
    if max_files is None:
        chosen, beyond = wanted, None
    else:
        # A record's attachments are one input row's list, so this window is bounded by it.
        ranked = wanted.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy("position")))
        chosen, beyond = ranked.where(F.col("__rank") <= max_files).drop("__rank"), ranked.where(F.col("__rank") > max_files).drop("__rank")
    misses = chosen.join(documents.select(url), url, "left_anti").withColumn("left_out", F.lit(False))
    if beyond is not None:
        misses = misses.unionByName(beyond.select(*chosen.columns, F.lit(True).alias("left_out")))
    return chosen.join(documents, url), misses


def attach_payload(
    records: DataFrame,
    payloads: DataFrame,
    rendered_url: Column,
    target: str,
    title_patterns: Sequence[str] = (),
    title: str = "title",
) -> DataFrame:
    """Related JSON of records whose title matches; others keep a null."""
    hit = F.lit(not title_patterns)
    for pattern in title_patterns:
        hit = hit | F.coalesce(F.col(title), F.lit("")).rlike(f"(?iu){pattern}")
    keyed = records.withColumn("__related", F.when(hit, rendered_url))
    side = payloads.select(F.col("url").alias("__related"), F.col("payload").alias(target))
    # Records without a related address stay out of the join, where one null key would take them all.
    related = keyed.where(F.col("__related").isNotNull()).join(side, "__related", "left")
    alone = keyed.where(F.col("__related").isNull())
    nothing = F.lit(None).cast(side.schema[target].dataType).alias(target)
    return related.unionByName(alone.select("*", nothing)).withColumn(
        "related_error", F.when(F.col("__related").isNotNull() & F.col(target).isNull(), F.col("__related"))
    ).drop("__related")


def detail_order(records: DataFrame) -> DataFrame:
    """Result order of a crawl: newest first, then record id."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return records.orderBy(blank("published_at").desc(), blank("record_id").desc())
