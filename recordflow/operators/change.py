"""Inserts, patches, updates, deletes and archives as new snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recordflow.functions.jsonx import json_or_empty
from recordflow.functions.text import clean, norm_email, short_id
from recordflow.operators.agg import rollup_status
from recordflow.operators.join import left_unique, without_child
from recordflow.operators.number import numbered
from recordflow.operators.select import active
from recordflow.operators.slugs import dedupe_slugs, taken_slugs
from recordflow.schemas import DEFAULTS, Edge
from recordflow.session import materialize


def _lit(value, like) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(like)


#: Order values whose rows are numbered in one task: these are whole rows, with their texts.
ROWS_AT_ONCE = 1 << 14


def assign_ids(new: DataFrame, order: str, start: int, key: str = "id") -> DataFrame:
    """Consecutive keys after ``start``, in order of a unique integer column."""
    return numbered(new, [], order, key, ROWS_AT_ONCE).withColumn(key, F.col(key) + start)


def insert_rows(base: DataFrame, new: DataFrame, defaults: dict | None = None, now=None,
                who=None) -> DataFrame:
    """``base`` plus ``new``. Columns that ``new`` leaves out get their default; an explicit
    NULL stays. Audit columns are stamped with one time for the whole batch."""
    fill = {"is_active": True, "created_on": now, "modified_on": now, "created_by": who,
            "modified_by": who, **(defaults or {})}
    fields = [F.col(f.name) if f.name in new.columns
              else _lit(fill.get(f.name), f.dataType).alias(f.name) for f in base.schema.fields]
    return base.unionByName(new.select(*fields))


def patch(base: DataFrame, patches: DataFrame, key: str, cleaned=(), nullable_blank=()) -> DataFrame:
    """Set the fields a patch gives, keep those it leaves NULL. ``cleaned`` fields are stripped;
    ``nullable_blank`` fields are stripped and become NULL where empty. One patch per key."""
    given = [c for c in patches.columns if c != key]
    side = patches.select(F.col(key), *[F.col(c).alias(f"_p_{c}") for c in given])
    out = []
    for c in base.columns:
        new = F.col(f"_p_{c}") if c in given else None
        if new is None:
            out.append(F.col(c))
        elif c in nullable_blank:
            out.append(F.when(new.isNotNull(), F.nullif(clean(new), F.lit("")))
                       .otherwise(F.col(c)).alias(c))
        elif c in cleaned:
            out.append(F.when(new.isNotNull(), clean(new)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(new, F.col(c)).alias(c))
    return base.join(side, key, "left").select(*out)


def fold_patches(patches: DataFrame, key: str, order: str) -> DataFrame:
    """One patch per key out of several: for each field the last value given."""
    fields = [c for c in patches.columns if c not in (key, order)]
    return patches.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def update_where(df: DataFrame, predicate: str, sets: dict[str, str],
                 count: Observation | None = None) -> DataFrame:
    """Set expressions where the predicate holds, all on the old values. With an Observation,
    the number of rows hit (``rows``) is counted in the same pass."""
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    if count is not None:
        df = df.observe(count, F.count_if(hit).alias("rows"))
    return df.select(*[
        F.when(hit, F.expr(sets[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in sets else F.col(f.name) for f in df.schema.fields])


def delete_where(df: DataFrame, predicate: str, count: Observation | None = None) -> DataFrame:
    """Without the rows the predicate holds for; rows it is NULL for stay."""
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    if count is not None:
        df = df.observe(count, F.count_if(hit).alias("rows"))
    return df.filter(~hit)


def stamp(df: DataFrame, changed: Column, now, who=None) -> DataFrame:
    """Refresh modified_on / modified_by of changed rows, with one time per batch."""
    hit = F.coalesce(changed, F.lit(False))
    values = {"modified_on": _lit(now, "timestamp_ntz"), "modified_by": _lit(who, "bigint")}
    return df.withColumns({
        c: F.when(hit, v).otherwise(F.col(c) if c in df.columns else F.lit(None))
        for c, v in values.items()})


def _marked(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    side = keys.select(F.col(keys.columns[0]).alias("_gone_key")).distinct().withColumn(
        name, F.lit(True))
    return left_unique(df, side, [(key, "_gone_key")], [name]).withColumn(
        name, F.coalesce(name, F.lit(False)))


def archive(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows with these keys become status 'archived' and inactive."""
    hit = F.col("_gone")
    return (_marked(df, key, keys, "_gone")
            .withColumn("status", F.when(hit, "archived").otherwise(F.col("status")))
            .withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
            .drop("_gone"))


def archive_pages(pages: DataFrame, elements: DataFrame, keys: DataFrame, key: str = "id",
                  fk: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Archive pages together with all their elements."""
    return archive(pages, key, keys), archive(elements, fk, keys)


def archive_elements(pages: DataFrame, elements: DataFrame, keys: DataFrame, key: str = "id",
                     page_key: str = "id", fk: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Archive elements and work out the status of just the pages they belong to."""
    after = archive(elements, key, keys)
    touched = elements.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")
    marked = _marked(pages, page_key, touched.select(fk), "_touched")
    fresh = rollup_status(marked, page_key, after, fk, only=F.col("_touched"))
    return fresh.drop("_touched"), after


def delete_cascade(tables: dict[str, DataFrame], edges: list[Edge], name: str,
                   keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Delete rows of ``name`` and follow the declared keys: cascade deletes, set_null clears,
    restrict reports. Returns the tables and (edge, rows) counts of restricted references,
    None without any such edge; a caller that finds rows there must not write the tables.
    """
    out = dict(tables)
    doomed: dict[str, DataFrame] = {}
    blocked = []
    for table in _parents_first(edges, name):
        df = out[table]
        # Children may point at different columns of one table; each is looked up by its own.
        wanted = sorted({e.key for e in edges if e.parent == table})
        gone = F.lit(False)
        flags = []
        if table == name:
            given = keys.columns[0]
            own = given if given in df.columns or not wanted else wanted[0]
            df = _marked(df, own, keys, "_own")
            gone, flags = F.col("_own"), ["_own"]
        cleared: dict[str, list[str]] = {}
        for i, edge in enumerate(e for e in edges if e.child == table and e.parent in doomed):
            flag = f"_e{i}"
            df = _marked(df, edge.fk, doomed[edge.parent].select(edge.key), flag)
            flags.append(flag)
            if edge.on_delete == "cascade":
                gone = gone | F.col(flag)
            elif edge.on_delete == "set_null":
                cleared.setdefault(edge.fk, []).append(flag)
            else:
                label = f"{edge.child}.{edge.fk}->{edge.parent}.{edge.key}"
                blocked.append(df.filter(flag).agg(F.count(F.lit(1)).alias("n"))
                               .select(F.lit(label).alias("edge"), "n"))
        if wanted:
            # Written once: the tables below start from these keys, not from the tables above.
            doomed[table] = materialize(df.filter(gone).select(*wanted), "doomed")
        kept = df.filter(~gone)
        for fk, marks in cleared.items():
            hit = reduce(Column.__or__, [F.col(m) for m in marks])
            kept = kept.withColumn(fk, F.when(~hit, F.col(fk)))
        out[table] = kept.drop(*flags)
    report = None
    for part in blocked:
        report = part if report is None else report.unionByName(part)
    return out, report


def _parents_first(edges: list[Edge], root: str) -> list[str]:
    """The root and all tables below it, each after the tables it points at."""
    below, todo = {root}, [root]
    while todo:
        at = todo.pop()
        for edge in edges:
            if edge.parent == at and edge.child not in below:
                below.add(edge.child)
                todo.append(edge.child)
    order: list[str] = []
    while len(order) < len(below):
        ready = [t for t in sorted(below - set(order))
                 if all(e.parent in order or e.parent not in below
                        for e in edges if e.child == t)]
        if not ready:
            raise ValueError("the declared keys form a cycle")
        order.extend(ready)
    return order


def ensure_child(users: DataFrame, key: str, children: DataFrame, owner: str, template: dict,
                 active_only: bool = True) -> DataFrame:
    """One child from the template for every user without any."""
    lacking = without_child(users, key, children, owner, active_only)
    return lacking.select(F.col(key).alias(owner), *[
        (v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in template.items()])


# What a new user starts with.
STARTER_PROJECT = {"name": "My first project", "description": "Starter project",
                   "status": "draft", "default_browser": "chromium", "headed": False,
                   "retries": 0, "timeout_ms": 30000, "trace_mode": "retain-on-failure"}
STARTER_SCENARIO = {"name": "Starter scenario", "source_text": 'TEST "Starter scenario"\nFIN',
                    "status": "draft", "ast_json": "{}", "steps_json": "[]",
                    "validation_json": "{}", "generated_code": ""}


def starter_rows(users: DataFrame, key: str, projects: DataFrame, owner: str = "owner_id",
                 active_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(projects, scenarios) to add for users without a project. The project's slug comes from a
    stable id of the user, an integer, and is told apart from those of other users and of
    ``projects`` where these have slugs; scenarios carry the owner and the project's slug."""
    slug = F.concat(F.lit("starter-"), short_id(8, owner))
    fresh = ensure_child(users, key, projects, owner, STARTER_PROJECT, active_only).withColumn(
        "slug", slug)
    existing = taken_slugs(projects, taken="all") if "slug" in projects.columns else None
    named = dedupe_slugs(fresh.filter(F.col(owner).isNotNull()).select("slug", owner).distinct(),
                         "slug", owner, existing)
    fresh = (fresh.join(named.select(owner, "unique_slug"), owner, "left")
             .withColumn("slug", F.coalesce("unique_slug", "slug")).drop("unique_slug"))
    scenarios = fresh.select(owner, F.col("slug").alias("project_slug"), *[
        F.lit(v).alias(c) for c, v in STARTER_SCENARIO.items()])
    return fresh, scenarios


def intake(df: DataFrame, projects: DataFrame, owner: str = "owner_id",
           project_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Feedback rows -> (accepted, rejected with ``reason``).

    Subject and message are stripped and required, the address is lower-cased, and the project
    must be the user's own active one, checked only when both user and project are given.
    """
    cleaned = df.withColumns({"subject": clean("subject"), "message": clean("message"),
                              "contact_email": norm_email("contact_email")})
    own = active(projects).select(F.col(project_key).alias("_pid"), F.col(owner).alias("_uid"),
                                  F.lit(True).alias("_own")).distinct()
    joined = left_unique(cleaned, own, [("project_id", "_pid"), ("user_id", "_uid")], ["_own"])
    asks = F.coalesce(F.col("user_id") != 0, F.lit(False)) & F.coalesce(
        F.col("project_id") != 0, F.lit(False))
    reason = (F.when(F.col("subject") == "", "subject_required")
              .when(F.col("message") == "", "message_required")
              .when(asks & F.col("_own").isNull(), "no_access"))
    marked = joined.withColumn("reason", reason).drop("_own")
    accepted = marked.filter(F.col("reason").isNull()).drop("reason")
    missing = {c: F.lit(v) for c, v in DEFAULTS["feedback"].items() if c not in df.columns}
    return (accepted.withColumns({**missing, "status": F.lit("new")}),
            marked.filter(F.col("reason").isNotNull()))


def reply(base: DataFrame, replies: DataFrame, now, key: str = "id",
          status: str = "answered") -> DataFrame:
    """Store admin replies: cleaned text, status, time. One reply per key."""
    side = replies.select(F.col(key), clean("admin_reply").alias("admin_reply"),
                          F.lit(status).alias("status"),
                          _lit(now, "timestamp_ntz").alias("replied_on"))
    return patch(base, side, key)


def store_compiled(base: DataFrame, results: DataFrame, now, key: str = "id",
                   versions: tuple[str, str] = ("v1", "v1")) -> DataFrame:
    """Write compiler results onto scenarios: structured fields become JSON text with {} / []
    for nothing, the time and versions are set, the status only where given."""
    empties = {"ast": "{}", "steps": "[]", "validation": "{}", "source_map": "[]"}
    cols = [F.col(key)]
    for name, empty in empties.items():
        if name in results.columns:
            cols.append(json_or_empty(name, empty).alias(f"{name}_json"))
        else:
            cols.append(F.lit(empty).alias(f"{name}_json"))
    cols.append(F.coalesce("generated_code", F.lit("")).alias("generated_code")
                if "generated_code" in results.columns else F.lit("").alias("generated_code"))
    cols += [F.lit(versions[0]).alias("parser_version"),
             F.lit(versions[1]).alias("compiler_version"),
             _lit(now, "timestamp_ntz").alias("last_compiled_on")]
    if "status" in results.columns:
        cols.append(F.col("status"))
    return patch(base, results.select(*cols), key)
