"""Row-level visibility: gates on chunks, subjects of users, authorised knowledge bases, department paths, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import size_checked, spread_join

ADMIN = 40


def clearance_gate(clearance: Column) -> Column:
    return F.col("level_rank") <= clearance


def deny_gate(subjects: Column) -> Column:
    return ~F.arrays_overlap(F.coalesce("deny_subjects", F.array().cast("array<string>")), subjects)


def tag_gate(subjects: Column) -> Column:
    return F.arrays_overlap("acl_tags", subjects)


def base_gate(tenant: Column) -> Column:
    return (F.col("tenant_id") == tenant) & F.col("is_latest")


def visible(clearance: Column, subjects: Column, tenant: Column) -> Column:
    """Tenant, version, clearance, deny and tag gates, all of them; the knowledge-base gate is the join's key."""
    return base_gate(tenant) & clearance_gate(clearance) & deny_gate(subjects) & tag_gate(subjects)


def secured(chunks: DataFrame, principals: DataFrame) -> DataFrame:
    """The chunks each principal may read, with its principal_id. Principals meet chunks on the knowledge bases they
    are authorised for; one without any has no rows."""
    grants = principals.select("principal_id", "p_tenant", "clearance", "subjects", F.explode(F.array_distinct("kbs")).alias("kb_id"))
    seen = chunks.join(size_checked(grants), "kb_id").where(visible(F.col("clearance"), F.col("subjects"), F.col("p_tenant")))
    return seen.drop("p_tenant", "clearance", "subjects")


def fully_visible_documents(chunks: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal_id, document_id) of documents none of whose latest chunks fails a gate. Administrators pass.

    A document's chunks come down to its distinct requirements (level, tags, denied subjects). Each meets the principals by
    equality of a tag with a subject (an administrator has one more, which every requirement has); a document is visible to
    those who meet all of its requirements.
    """
    admin = F.lit("*administrator*")
    needs = chunks.where("is_latest").groupBy("document_id", "level_rank", "acl_tags", "deny_subjects").agg(F.lit(1).alias("one"))
    needs = needs.withColumn("need", F.struct("level_rank", "acl_tags", "deny_subjects"))
    counts = needs.groupBy("document_id").agg(F.count("*").alias("needs"))
    tagged = needs.select("document_id", "need", F.explode(F.array_distinct(F.array_append(F.coalesce("acl_tags", F.array().cast("array<string>")), admin))).alias("subject"))
    held = F.when(F.col("clearance") >= ADMIN, F.array_append("subjects", admin)).otherwise(F.col("subjects"))
    people = principals.select("principal_id", "clearance", "subjects", F.explode(F.array_distinct(held)).alias("subject"))
    denied = F.arrays_overlap(F.coalesce("need.deny_subjects", F.array().cast("array<string>")), "subjects")
    passes = (F.col("subject") == admin) | ((F.col("need.level_rank") <= F.col("clearance")) & ~denied)
    met = spread_join(tagged, people, "subject", "document_id").where(passes).select("principal_id", "document_id", "need").distinct()
    met = met.groupBy("principal_id", "document_id").agg(F.count("*").alias("met"))
    return met.join(counts, "document_id").where("met = needs").select("principal_id", "document_id")


def normal_path(path: Column) -> Column:
    """`/a/b/`; null for a path without parts."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")))


def ancestors(path: Column) -> Column:
    """From the root to the path itself."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))


def visible_descendants(own: DataFrame, departments: DataFrame) -> DataFrame:
    """(path, descendant): departments below `own.path` that every level under it shows to its parent.

    A department meets each of its ancestors by equality, so there is no prefix join; a hidden level between hides all
    that is below it.
    """
    hidden = departments.where(~F.col("visible_to_parent")).select(F.col("path").alias("level"))
    chain = departments.select(F.col("path").alias("descendant"), F.posexplode(ancestors(F.col("path"))).alias("depth", "level"))
    blocked = chain.join(size_checked(hidden), "level").groupBy("descendant").agg(F.max("depth").alias("hidden_at"))
    up = chain.join(own.select(F.col("path").alias("level")).distinct(), "level").where("level <> descendant")
    return up.join(blocked, "descendant", "left").where("hidden_at IS NULL OR hidden_at <= depth").select(F.col("level").alias("path"), "descendant")


def user_subjects(users: DataFrame, departments: DataFrame) -> DataFrame:
    """(user_id, subjects) of users (user_id, dept_path, groups, roles, region): sorted, each once."""
    below = visible_descendants(users.select(F.col("dept_path").alias("path")), departments).groupBy("path").agg(F.collect_set(F.concat(F.lit("dept:"), "descendant")).alias("below"))
    joined = users.join(below, users.dept_path == below.path, "left")
    prefixed = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(kind), x))
    parts = [
        F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.lit("public")),
        prefixed("group:", F.col("groups")),
        prefixed("role:", F.col("roles")),
        F.when(F.coalesce("region", F.lit("")) != "", F.array(F.concat(F.lit("region:"), "region"))).otherwise(F.array().cast("array<string>")),
        prefixed("dept:", F.when(F.col("dept_path").isNotNull(), ancestors(F.col("dept_path")))),
        F.coalesce("below", F.array().cast("array<string>")),
    ]
    return joined.select("user_id", F.array_sort(F.array_distinct(F.concat(*parts))).alias("subjects"))


def authorised_kbs(people: DataFrame, kbs: DataFrame) -> DataFrame:
    """(principal_id, kb_id): public knowledge bases of the tenant, and those whose members meet the subjects."""
    open_kbs = people.select("principal_id", "tenant_id").join(kbs.where("is_public").select("kb_id", "tenant_id"), "tenant_id").select("principal_id", "kb_id")
    mine = people.select("principal_id", "tenant_id", F.explode("subjects").alias("member"))
    theirs = kbs.select("kb_id", "tenant_id", F.explode("members").alias("member"))
    return open_kbs.union(mine.join(theirs, ["tenant_id", "member"]).select("principal_id", "kb_id")).distinct()


def tag_violation(tags: Column) -> Column:
    """Why tags can't be stored; null if they can."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(kept) == 0, "empty").when(F.array_contains(kept, "public") & (F.size(F.array_distinct(kept)) > 1), "public_not_alone").when(F.exists(kept, lambda t: F.startswith(t, F.lit("level:"))), "level_tag")


def document_tags(dept_path: Column, extra: Column) -> Column:
    """The document's own department and its extra tags; `public` if there are none."""
    path = normal_path(dept_path)
    kept = F.filter(F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.array_sort(F.array_distinct(F.when(path.isNotNull(), F.array_append(kept, F.concat(F.lit("dept:"), path))).otherwise(kept)))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("public")))


def moved_path(path: Column, old: Column, new: Column) -> Column:
    """The path after `old` moved to `new`; other paths stay."""
    return F.when(F.startswith(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)
