"""Link sign-ins to users: one user per e-mail address, whatever the provider."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions.normalize import strip


@dataclass(frozen=True)
class Linked:
    """What a batch of sign-ins resolves to."""

    resolved: DataFrame  # provider, provider_id, email, user_id, is_new
    new_users: DataFrame  # user_id, email
    new_links: DataFrame  # user_id, provider, provider_id


def normal_email(email: Column) -> Column:
    return F.lower(strip(email))


def link_identities(signins: DataFrame, users: DataFrame, links: DataFrame) -> Linked:
    """Resolve a batch of sign-ins (seq, provider, provider_id, email) against users and links.

    A known (provider, provider_id) keeps its user. Otherwise the normalized e-mail decides, and an
    address seen for the first time becomes a user whose id is derived from the address, so two
    providers in one batch meet in one user and a rerun gives the same ids. A user gets at most one
    link per provider, the earliest of the batch. Within a batch an identity follows its first sign-in; one
    that is neither linked nor has an address gets no user.

    Repeated sign-ins collapse before the first join, so a busy identity is one row from there on.
    """
    identity = ["provider", "provider_id"]
    seen = signins.groupBy(*identity, normal_email(F.col("email")).alias("email")).agg(F.min("seq").alias("seq"))
    first = seen.groupBy(*identity).agg(F.min(F.struct("seq", "email")).alias("f"))
    known = links.select(*identity, F.col("user_id").alias("linked_user"))
    by_email = users.select(normal_email(F.col("email")).alias("email"), F.col("user_id").alias("known_user"))
    linked = first.select(*identity, F.col("f.seq").alias("seq"), F.col("f.email").alias("email")).join(known, identity, "left")
    # A sign-in without an address meets nobody; however many there are, they stay out of the join.
    anonymous = linked.where("email is null").withColumn("known_user", F.lit(None).cast(by_email.schema["known_user"].dataType))
    placed = linked.where("email is not null").join(by_email, "email", "left").unionByName(anonymous)
    fresh = F.concat(F.lit("u-"), F.substring(F.sha2("email", 256), 1, 32))
    resolved = placed.withColumn("user_id", F.coalesce("linked_user", "known_user", fresh)).withColumn(
        "is_new", F.col("linked_user").isNull() & F.col("known_user").isNull() & F.col("email").isNotNull()
    )
    new_users = resolved.where("is_new").select("user_id", "email").distinct()
    taken = links.select("user_id", "provider").distinct()
    candidates = resolved.where(F.col("linked_user").isNull() & F.col("user_id").isNotNull()).join(taken, ["user_id", "provider"], "left_anti")
    earliest = Window.partitionBy("user_id", "provider").orderBy("seq", "provider_id")
    new_links = candidates.withColumn("turn", F.row_number().over(earliest)).where("turn = 1")
    return Linked(
        resolved.select(*identity, "email", "user_id", "is_new"),
        new_users,
        new_links.select("user_id", *identity),
    )
