"""Schemas of the tables that move through the engine; nothing is inferred."""

ENTRY = """root string, path string, name string, kind string, apparent bigint, allocated bigint, nlink bigint,
    dev bigint, ino bigint, mtime bigint, mtime_nanos int, cloud boolean, excluded boolean, error string"""
STAGED = """seq bigint, path string, kind string, allocated bigint, apparent bigint, mtime bigint, mtime_nanos int,
    dev bigint, ino bigint, nlink bigint, entry_count bigint, source string, reason string, staged_at bigint"""
JOURNAL = "timestamp bigint, operation string, path string, destination string, size bigint, result string, error string"
CACHE = "path string, size bigint, mtime bigint, dev bigint, ino bigint, partial_bytes bigint, partial string, full string"
RULE = """rule_id int, ecosystem string, markers array<string>, artifacts array<string>, risk string, risk_rank int, regenerate string,
    caution_without array<string>, kind string, defines_project boolean, clean array<string>, note string"""
VOLUME = "mount string, device string, fs string, total bigint, available bigint, network boolean"
DOCKER = "Type string, TotalCount string, Active string, Size string, Reclaimable string"
