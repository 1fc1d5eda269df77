"""Schemas of the engine's tables, as DDL that readers and createDataFrame take."""

VECTORS = "id string, collection string, file_path string, start_line int, end_line int, language string, chunk_type string, project_name string, name string, content string, embedding array<float>"
COLLECTIONS = "collection string, version string, dimension int, seq long"
MEMORY_NODES = (
    "id string, node_type string, content string, summary string, keywords string, file_path string, line_range string, source string, project_path string, archived boolean,"
    " created_at timestamp, updated_at timestamp, agent_id string"
)
FILE_ANCHORS = "anchor_id string, memory_id string, file_path string, stored_hash string, line_start int, line_end int, is_stale boolean, created_at timestamp"
LOCK_LOG = "seq long, agent_id string, project string, pattern string, branch string, acquired_at timestamp"
SUBSCRIPTIONS = "agent_id string, project string, file_pattern string, created_at timestamp"
NOTIFICATIONS = "id string, subscriber_agent_id string, memory_id string, memory_summary string, file_path string, author_agent_id string, created_at timestamp, read_at timestamp"
SESSIONS = "agent_id string, project string, worktree_path string, branch string, connected_at timestamp, last_activity_at timestamp, status string"
EMBEDDING_CACHE = "content_hash string, provider string, embedding array<float>"
SNAPSHOT = "path string, hash string, taken_at timestamp, project string, snapshot string"
FILE_EVENTS = "event_id long, project string, path string, to_path string, kind string, ts timestamp"
