"""Explicit, closed schemas of the record kinds and published tables."""

from __future__ import annotations

_PROV = "source STRING, source_id STRING"
ACTORS = f"{_PROV}, name STRING, aliases ARRAY<STRING>, origin ARRAY<STRING>, sponsor ARRAY<STRING>, motivation ARRAY<STRING>, targets_countries ARRAY<STRING>, targets_sectors ARRAY<STRING>, first_seen ARRAY<STRING>, malware ARRAY<STRING>, techniques ARRAY<STRING>, retrieved_at STRING"
REPORTS = f"{_PROV}, title STRING, published STRING, date_basis STRING, organisation STRING, url STRING, archive_url STRING, sha1 STRING, actor_names ARRAY<STRING>, name_mentions ARRAY<STRUCT<name: STRING, count: INT, first: INT>>, cves ARRAY<STRING>, techniques ARRAY<STRING>, retrieved_at STRING"
CAMPAIGNS = f"{_PROV}, name STRING, first_seen STRING, last_seen STRING, actor_refs ARRAY<STRING>, techniques ARRAY<STRING>, report_urls ARRAY<STRING>, retrieved_at STRING"
VULNERABILITIES = "cve STRING, date_added STRING, ransomware BOOLEAN, vendor STRING, product STRING, epss DOUBLE, epss_percentile DOUBLE, retrieved_at STRING"
SOFTWARE = f"{_PROV}, name STRING, aliases ARRAY<STRING>, kind STRING, attribution ARRAY<STRING>, retrieved_at STRING"
RECORDS = {"actors": ACTORS, "reports": REPORTS, "campaigns": CAMPAIGNS, "vulnerabilities": VULNERABILITIES, "software": SOFTWARE}
