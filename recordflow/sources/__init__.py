from recordflow.sources.events import event_stream
from recordflow.sources.feeds import render_ics, render_rss, write_feed
from recordflow.sources.files import (artifact_columns, artifact_manifest, ingest_messy, read_csv, read_json,
                                      read_xml, split_corrupt, write_csv, write_json, write_xml)
from recordflow.sources.tables import scan, scan_all

__all__ = ["artifact_columns", "artifact_manifest", "event_stream", "ingest_messy", "read_csv", "read_json",
           "read_xml", "render_ics", "render_rss", "scan", "scan_all", "split_corrupt",
           "write_csv", "write_feed", "write_json", "write_xml"]
