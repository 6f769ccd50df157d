"""Roles, scopes and permissions as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEVEL = {"owner": 4, "admin": 3, "editor": 2, "viewer": 1}
PERMISSIONS = ["read", "sync", "delete", "admin"]
IMPLIED = {"admin": PERMISSIONS, "delete": ["read", "delete"], "sync": ["read", "sync"], "read": ["read"]}


def role_level(role: Column) -> Column:
    """4 for owner down to 1 for viewer; 0 for anything else."""
    out = F.lit(0)
    for name, level in LEVEL.items():
        out = F.when(role == name, level).otherwise(out)
    return out


def has_role(role: Column, least: str) -> Column:
    return role_level(role) >= LEVEL[least]


def has_scope(scopes: Column, wanted: str, aliases: Sequence[str] = ()) -> Column:
    """No scopes at all don't restrict; else the scope itself, an alias, or `*`."""
    return scopes.isNull() | (F.size(scopes) == 0) | F.arrays_overlap(scopes, F.array(*map(F.lit, [wanted, "*", *aliases])))


def implied(permission: Column) -> Column:
    """All that one permission grants; nothing for an unknown one."""
    p = F.trim(permission)
    out = F.array().cast("array<string>")
    for name, all_ in IMPLIED.items():
        out = F.when(p == name, F.array(*map(F.lit, all_))).otherwise(out)
    return out


def ordered(permissions: Column) -> Column:
    """Distinct permissions in their fixed order."""
    return F.filter(F.array(*map(F.lit, PERMISSIONS)), lambda p: F.array_contains(permissions, p))


def may_manage(actor: Column, target: Column, to: Column | None = None) -> Column:
    """Whether a role may change a member: owners all, admins all below admin, and to below admin only."""
    below = role_level(target) < LEVEL["admin"]
    if to is not None:
        below = below & (role_level(to) < LEVEL["admin"])
    return (actor == "owner") | ((actor == "admin") & below)
