"""Citation tags: attributes to one reference, or the reason why there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes that name an item, in order of precedence, and those that hold a place in it.
IDENTITIES = ["id", "att_id", "attachment_id", "item_id"]
PLACES = ["loc", "sid", "page"]
#: Fixed value: what a sanitizer puts before ids.
CLOBBER = "user-content-"


def reference(attrs: Column) -> Column:
    """attrs: map<string, string>. struct<kind, id, place, reason>.

    kind is item, file or external. An item is named `u-KEY`, `g<group>-KEY` or `<library>-KEY`, a file `ext-KEY`. Naming
    both an item and something external is a conflict, as is naming nothing, an item that has no such form, or only
    white space; then kind and id are null and reason says which.
    """
    plain = lambda c: F.regexp_replace(c, F.lit(f"^{CLOBBER}"), F.lit(""))
    own = plain(F.coalesce(*[F.try_element_at(attrs, F.lit(n)) for n in IDENTITIES]))
    other = plain(F.try_element_at(attrs, F.lit("external_id")))
    file = F.upper(F.regexp_extract(own, r"(?i)^ext-([a-z0-9]{8})$", 1))
    named = own.rlike(r"^(?:u|g[1-9]\d*|[1-9]\d*)-.+$")
    reason = (
        F.when(own.isNotNull() & other.isNotNull(), "conflicting_identity")
        .when(own.isNotNull() & (file == "") & ~named, "invalid_item_id")
        .when(own.isNull() & other.isNull(), "missing_identity")
        .when(own.isNull() & (F.trim(other) == ""), "invalid_external_id")
    )
    kind = F.when(own.isNull(), "external").when(file != "", "file").otherwise("item")
    id_ = F.when(own.isNull(), other).when(file != "", file).otherwise(own)
    place = F.coalesce(*[F.try_element_at(attrs, F.lit(n)) for n in PLACES])
    right = reason.isNull()
    return F.struct(F.when(right, kind).alias("kind"), F.when(right, id_).alias("id"), F.when(right, place).alias("place"), reason.alias("reason"))
