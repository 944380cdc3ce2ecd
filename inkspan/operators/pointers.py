"""Names of scanned pages and where two archives keep them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The archives' addresses.
PROCEEDINGS = "https://www.dhi.ac.uk/san"
REPORTS = "https://tile.loc.gov/storage-services/service/ll/usrep"
FIRST_NEW_YEAR, VOLUMES = 1834, (1, 542)


def proceedings_url(ptr: Column) -> Column:
    """Accounts (OA...) by their date or issue, sessions before 1834 by decade, later ones by their date."""
    accounts = F.when(F.substring(ptr, 11, 1).rlike("^[0-9]$"), F.substring(ptr, 1, 10)).otherwise(F.left(ptr, F.length(ptr) - 4))
    account = F.concat(F.lit(f"{PROCEEDINGS}/oa/"), accounts, F.lit("/"), ptr, F.lit(".jpg"))
    old = F.concat(F.lit(f"{PROCEEDINGS}/ob/"), F.substring(ptr, 1, 3), F.lit("0s/"), ptr, F.lit(".gif"))
    new = F.concat(F.lit(f"{PROCEEDINGS}/ccc/"), F.substring(ptr, 1, 8), F.lit("/"), ptr, F.lit(".jpg"))
    year = F.substring(ptr, 1, 4).try_cast("int")
    return F.when(F.startswith(ptr, F.lit("OA")), account).when(year < FIRST_NEW_YEAR, old).otherwise(new)


def report_url(ptr: Column) -> Column:
    return F.concat_ws("/", F.lit(REPORTS), F.substring(ptr, 1, 8), ptr, F.concat(ptr, F.lit(".pdf")))


def short_report(ptr: Column) -> Column:
    """usrep001005a as 001us005a; a pointer of another form is null."""
    return F.when(ptr.rlike("usrep[0-9]{3}"), F.regexp_replace(F.regexp_replace(ptr, "^usrep", ""), "^(...)", "$1us"))


def volume_name(volume: Column) -> Column:
    """001us for volume 1; null outside 1 to 542."""
    low, high = VOLUMES
    return F.when(volume.between(low, high), F.concat(F.lpad(volume.cast("string"), 3, "0"), F.lit("us")))


def only_corpus_files(name: Column, extension: str, excluded: list[str]) -> Column:
    """Whether a file belongs to the corpus. The excluded cases are the caller's list."""
    return F.endswith(name, F.lit(extension)) & ~name.isin(excluded)
