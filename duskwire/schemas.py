"""Table and record layouts as Spark DDL."""

RAW_EVENT = (
    "event_id string, source_id string, adapter_type string, mode string, observed_at timestamp, "
    "collected_at timestamp, content_type string, payload_ref string, content_hash string, "
    "policy_decision_id string, language string, raw_metadata string, redactions array<string>"
)
ADAPTER_TYPES = ["synthetic", "replay", "osint_feed", "clearnet_intel", "blockchain", "authorized"]
MODES = ["live", "replay", "authorized"]
CONTENT_TYPES = ["text", "json"]

SOURCES = (
    "source_id string, source_type string, authorization_status string, authorization_ref string, "
    "enabled boolean, retention_days int, pii_policy string, reliability_grade string"
)
ENTITIES = (
    "entity_id string, kind string, value string, normalized string, first_seen timestamp, last_seen timestamp"
)
OBSERVATIONS = "event_id string, entity_id string, role string, observed_at timestamp"
EVIDENCE = (
    "evidence_id string, event_id string, content_hash string, merkle_batch_id string, "
    "collected_at timestamp, source_id string"
)
MERKLE_BATCHES = "batch_id string, root_hash string, leaf_count int, anchor_ref string, anchor_type string"
ACTORS = (
    "actor_id string, label string, category string, first_seen timestamp, last_seen timestamp, status string"
)
ACTOR_ENTITIES = "actor_id string, entity_id string, added_by string, added_at timestamp"
PERSONA_LINKS = (
    "link_id string, actor_a string, actor_b string, link_type string, score decimal(5,2), band string, "
    "model_version string, analyst_status string"
)
LINK_EVIDENCE = (
    "id string, link_id string, evidence_type string, raw_value string, llr decimal(8,4), "
    "reliability string, credibility smallint, note string"
)
INFRA_FINDINGS = (
    "finding_id string, onion_entity string, kind string, raw string, matched_clearnet string, "
    "confidence decimal(5,2), detected_at timestamp"
)
POSTS = "post_id string, actor_id string, handle string, market string, text string, posted_at timestamp, language string"
ALERTS = "alert_id string, alert_type string, subject string, score double, status string, created_at timestamp"
WATCHLIST = "item_id string, entity_id string, created_by string"
PROFILE = (
    "actor_id string, handle string, first_seen timestamp, last_seen timestamp, status string, "
    "pgp_fingerprints array<string>, wallet_addresses array<string>, contact_ids array<string>, "
    "handles array<string>, style_vector array<double>"
)
HOST = (
    "host string, tls_cert_sans array<string>, tls_cert_fingerprint string, favicon_hash string, "
    "server_banner string, http_headers map<string,string>, header_order array<string>, "
    "ssh_host_key string, error_page_hash string"
)
ONION = HOST.replace("host string", "address string", 1) + ", status_page_text string"
PROBES = "url string, probed_at timestamp, clock_skew double"
