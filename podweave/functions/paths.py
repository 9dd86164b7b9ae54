"""Pod identity from the path ``.../<namespace>_<pod>_<uid>/<container>/<n>.log``."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pod_metadata(path: Column) -> Column:
    """``struct<namespace, pod_name, pod_uid, container_name>`` with the defaults for what the path does not tell.

    The namespace ends at the first ``_`` of the pod directory, the uid starts behind its last one.
    """
    parts = F.split(path, "/")

    def part(index: int) -> Column:
        return F.nullif(F.try_element_at(parts, F.lit(index)), F.lit(""))

    file_name, container, pod_dir = part(-1), part(-2), part(-3)
    rest = F.when(pod_dir.contains("_"), F.regexp_extract(pod_dir, r"(?s)^[^_]*_(.*)$", 1))
    full = rest.contains("_")
    return F.struct(
        F.coalesce(F.when(rest.isNotNull(), F.substring_index(pod_dir, "_", 1)), F.lit("default")).alias("namespace"),
        F.coalesce(F.when(full, F.regexp_extract(rest, r"(?s)^(.*)_", 1)), file_name, F.lit("unknown")).alias("pod_name"),
        F.coalesce(F.when(full, F.substring_index(rest, "_", -1)), F.lit("unknown")).alias("pod_uid"),
        F.coalesce(container, F.lit("unknown")).alias("container_name"),
    )


def uri_to_path(uri: Column) -> Column:
    """Plain path of a file URI as Spark's ``_metadata.file_path`` gives it."""
    plain = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    # '+' is a literal character in a path; url_decode would read it as a space.
    return F.when(plain.contains("%"), F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))).otherwise(plain)
