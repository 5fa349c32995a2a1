"""Schemas of the relations, as DDL."""

from __future__ import annotations

CHUNK_REF = "struct<id:string,offset:bigint,len:bigint,raw_len:bigint>"
BLOBS = "path string, size long, modified timestamp, content binary"
COMMITS = "id string, parent string, author string, message string, timestamp_unix long, files_omitted boolean, schema_version int"
COMMIT_FILES = f"commit_id string, path string, size long, file_digest string, chunks array<{CHUNK_REF}>"
CHUNKS = "id string, raw_len long, stored_len long, segment_id long, offset long, compressed boolean, data binary"
MANIFEST_INDEX = f"path string, size long, modified timestamp, file_digest string, chunks array<{CHUNK_REF}>"
MATERIALIZED = "path string, state string, commit_id string, file_digest string, size long"
VIEW_RULES = "kind string, pattern string"
LOCKS = "repo string, path string, owner string"
LOCK_OPS = "path string, owner string, op string, seq long"
IDENTITIES = "token string, identity string"
ACL = "repo string, identity string, access string"

#: States of a file in a workspace. Pending is counted and shown but no operation assigns it.
NOT_IN_VIEW, VIRTUAL, HYDRATED, DIRTY, PENDING = STATES = ("NotInView", "Virtual", "Hydrated", "Dirty", "Pending")

#: Defaults of a repository's configuration.
MIB = 1 << 20
CHUNK_MIN, CHUNK_AVG, CHUNK_MAX = 1 * MIB, 4 * MIB, 16 * MIB
SMALL_FILE = 8 * MIB
LARGE_FILE, LARGE_WINDOW = 512 * MIB, 256 * MIB
SEGMENT = 128 * MIB
PAGE = 1 * MIB
HOT_PATHS, HOT_BYTES = ("code/...", "config/..."), 256 * 1024
BATCH, HISTORY, SAMPLE = 64, 32, 10
