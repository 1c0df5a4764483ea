"""Schemas of the engine's relations, as Spark DDL."""

REQUESTS = (
    "request_id long, session_id string, template_id string, text string, render_mode string, "
    "fake_provider string, language string, seq long, ts timestamp"
)
MENTION = "entity_id string, text string"
MENTIONS = f"request_id long, src_rank int, chunk_idx int, ordinal int, {MENTION}"
MODEL_OUTPUT = f"entities array<struct<{MENTION}>>"
SPAN = "entity_id string, text string, start int, end int, ordinal int, canon string"
MAPPING = "token_to_original map<string,string>, token_to_fake map<string,string>, fake_to_token map<string,string>"
META = (
    "session_id string, template_id string, template_version int, render_mode string, fake_provider string, "
    "model_runtime struct<requested_model: string, resolved_model: string, quantization_level: string>"
)
TEMPLATES = (
    "template_id string, version int, description string, "
    "entities array<struct<id: string, enabled: boolean, instructions: string, fake_provider: string, "
    "use_pseudo_entities: boolean, pseudo_entities: array<string>, examples: map<string, array<string>>>>, "
    "llm struct<model: string, system: string, max_entities: int>, "
    "canon struct<unicode_normalize: string, collapse_whitespace: boolean, casefold: boolean, strip_outer_punct: boolean>, "
    "replacement struct<placeholder_format: string, pseudonym: struct<mode: string, id_len: int, secret_env: string, "
    "providers: map<string, string>>>, "
    "postpass_alias struct<enabled: boolean, entity_ids: array<string>, min_token_len: int, window_size: int, "
    "min_overlap_tokens: int, session_ttl_seconds: int, max_aliases_per_entity: int>"
)
