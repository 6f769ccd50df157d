"""Who may see what: permissions on roots, deny prefixes, proofs of possession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.access import PERMISSIONS, has_role, implied, ordered
from quarrylake.functions.paths import ancestors

MOST_DENIES = 10_000  # deny prefixes of one root and user that are put into a plan


def _base(scope: Column, owner: Column, user: Column, role: Column) -> Column:
    """Permissions by scope and role alone."""
    names = lambda *p: F.array(*map(F.lit, p))
    none = names().cast("array<string>")
    org = F.concat(names("read"), F.when(has_role(role, "editor"), names("sync")).otherwise(none), F.when(has_role(role, "admin"), names("delete", "admin")).otherwise(none))
    full = names(*PERMISSIONS)
    own = F.when(owner == user, full).when(has_role(role, "admin"), full).otherwise(none)
    return F.when(scope.isNull() | scope.isin("", "org"), org).when(scope == "user", own).when((scope == "restricted") & has_role(role, "admin"), full).otherwise(none)


def root_permissions(roots: DataFrame, members: DataFrame, grants: DataFrame, group_members: DataFrame) -> DataFrame:
    """(root_id, user_id, permissions) of every member of a root's organisation.

    roots: root_id, org_id, scope, owner_user_id. members: org_id, user_id, role. grants: org_id, root_id,
    principal_type (org, user, group), principal_id, permissions. group_members: org_id, group_id, user_id.
    Grants add to what scope and role give; each implies the lesser ones; the result is in fixed order.
    """
    pairs = roots.join(members, "org_id").select("org_id", "root_id", "user_id", F.explode_outer(_base(F.col("scope"), F.col("owner_user_id"), F.col("user_id"), F.col("role"))).alias("p"))
    g = grants.select("org_id", "root_id", "principal_type", "principal_id", "permissions")
    direct = g.where("principal_type = 'user'").select("org_id", "root_id", F.col("principal_id").alias("user_id"), "permissions")
    all_org = g.where("principal_type = 'org' and principal_id = org_id").join(members.select("org_id", "user_id"), "org_id").select("org_id", "root_id", "user_id", "permissions")
    by_group = g.where("principal_type = 'group'").withColumnRenamed("principal_id", "group_id").join(group_members, ["org_id", "group_id"]).select("org_id", "root_id", "user_id", "permissions")
    given = direct.unionByName(all_org).unionByName(by_group).select("org_id", "root_id", "user_id", F.explode("permissions").alias("p"))
    valid = given.join(members.select("org_id", "user_id"), ["org_id", "user_id"], "left_semi").select("org_id", "root_id", "user_id", "p")
    each = pairs.unionByName(valid).select("root_id", "user_id", F.explode_outer(implied(F.col("p"))).alias("p"))
    return each.groupBy("root_id", "user_id").agg(ordered(F.collect_set("p")).alias("permissions"))


def allowed(permissions: Column, action: str) -> Column:
    """Whether a list of permissions allows an action."""
    enough = {action, "admin"} | ({"sync", "delete"} if action == "read" else set())
    return F.arrays_overlap(permissions, F.array(*map(F.lit, sorted(enough))))


def accessible_roots(permissions: DataFrame, user: str, action: str = "read") -> DataFrame:
    return permissions.where((F.col("user_id") == user) & allowed(F.col("permissions"), action)).select("root_id")


def denied_prefixes(acls: DataFrame, user: str, role: str) -> DataFrame:
    """(root_id, path_prefix) that are denied to a user or to the user's role, longest first in effect all alike."""
    return acls.where(F.col("grant_to").isin(user, f"role:{role}") & (F.col("permission") == "none")).select("root_id", "path_prefix").distinct()


def without_denied(rows: DataFrame, denies: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows whose path has no denied prefix in its root.

    A prefix ends in a slash, so it can only be `/` or a folder above the path: the folders are joined
    for equality, which works for any number of prefixes and needs no nested loop.
    """
    above = F.concat(F.array(F.lit("/")), F.transform(ancestors(F.col(path)), lambda a: F.concat(F.lit("/"), a, F.lit("/"))))
    bad = rows.select("root_id", path).distinct().select("root_id", path, F.explode(above).alias("path_prefix")).join(denies.select("root_id", "path_prefix"), ["root_id", "path_prefix"], "left_semi").select("root_id", path).distinct()
    return rows.join(bad, ["root_id", path], "left_anti")


def proven(rows: DataFrame, proof: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows whose (path, file_hash) a user's proof (root_id, path, hash) holds; no proof, no rows."""
    p = proof.select("root_id", F.col("path").alias(path), F.col("hash").alias("file_hash")).distinct()
    return rows.join(p, ["root_id", path, "file_hash"], "left_semi")


def writable_violations(changes: DataFrame, denies: DataFrame) -> DataFrame:
    """(root_id, path) that changes touch, old paths of moves included, though they are denied."""
    touched = changes.select("root_id", F.explode(F.array_compact(F.array("path", "old_path"))).alias("file_path")).distinct()
    return touched.join(without_denied(touched, denies), ["root_id", "file_path"], "left_anti").withColumnRenamed("file_path", "path")
