"""The structure of workflow documents.

For each kind of object its properties with what they hold: `string`, `id` (an identifier),
`commit`, `version`, `number`, `share` (0 to 1), `count` (an integer from 1), `boolean`,
`object` (any), `format`, `one of ...`, the name of another kind, or `list of` one of these.
`!` marks what must be there, `open` kinds may hold more.
"""

from __future__ import annotations

KINDS: dict[str, dict[str, str]] = {
    "document": {"format": "format !", "version": "version !", "project": "project", "nodes": "list of node !", "edges": "list of edge !", "prompts": "list of prompt", "models": "list of model", "tools": "list of tool", "data_sources": "list of data_source", "metadata": "metadata", "provenance": "provenance", "extensions": "object"},
    "project": {"name": "string", "description": "string", "version": "string", "repository": "string", "commit": "commit", "root": "string", "languages": "list of string", "frameworks": "list of framework"},
    "framework": {"name": "string !", "version": "string", "adapter": "string"},
    "source_ref": {"file": "string !", "start_line": "count", "end_line": "count", "symbol": "string", "language": "string", "commit": "commit", "url": "string"},
    "provenance": {"method": "one of static_analysis framework_adapter runtime_trace ai_inference manual !", "confidence": "share", "evidence": "list of source_ref", "generator": "generator", "generated_at": "string", "reviewed_by": "string", "notes": "string"},
    "generator": {"name": "string", "version": "string", "model": "string"},
    "port": {"name": "id !", "description": "string", "type": "string", "schema": "object", "required": "boolean"},
    "ai_context": {"provenance": "provenance", "summary": "string", "intent": "string", "failure_modes": "list of failure_mode", "invariants": "list of string", "side_effects": "list of string", "notes": "string"},
    "failure_mode": {"description": "string !", "handled": "boolean", "handler_node": "id", "source": "source_ref"},
    "node": {"id": "id !", "type": "one of agent llm tool prompt retriever vector_store input output condition !", "name": "string", "description": "string", "ref": "id", "config": "object", "inputs": "list of port", "outputs": "list of port", "depends_on": "list of id", "source": "list of source_ref", "ai_context": "ai_context", "provenance": "provenance", "tags": "list of string", "extensions": "object"},
    "edge": {"id": "id !", "type": "one of calls uses retrieves passes produces routes_to !", "source": "id !", "target": "id !", "source_port": "id", "target_port": "id", "label": "string", "when": "string", "default": "boolean", "payload": "payload", "optional": "boolean", "source_ref": "list of source_ref", "ai_context": "ai_context", "provenance": "provenance", "extensions": "object"},
    "payload": {"type": "string", "schema": "object", "description": "string"},
    "prompt": {"id": "id !", "name": "string", "description": "string", "role": "one of system user assistant tool developer composite", "template": "string", "template_format": "one of f-string jinja2 mustache literal other", "variables": "list of variable", "source": "list of source_ref", "ai_context": "ai_context", "provenance": "provenance", "extensions": "object"},
    "variable": {"name": "string !", "description": "string", "required": "boolean", "source_node": "id"},
    "model": {"id": "id !", "provider": "string !", "model": "string !", "parameters": "parameters", "structured_output": "object", "source": "list of source_ref", "provenance": "provenance", "extensions": "object"},
    "parameters": {"temperature": "number", "max_tokens": "count", "top_p": "number", "stop": "list of string", "streaming": "boolean"},
    "tool": {"id": "id !", "name": "string !", "description": "string", "kind": "one of function http_api mcp retrieval code_execution human_in_the_loop other", "parameters": "object", "returns": "payload", "side_effects": "boolean", "idempotent": "boolean", "source": "list of source_ref", "ai_context": "ai_context", "provenance": "provenance", "extensions": "object"},
    "data_source": {"id": "id !", "name": "string", "description": "string", "kind": "one of vector_store document_store sql graph key_value api file other !", "provider": "string", "config": "store_config", "source": "list of source_ref", "ai_context": "ai_context", "provenance": "provenance", "extensions": "object"},
    "store_config": {"index": "string", "namespace": "string", "embedding_model": "string", "dimensions": "count", "metric": "one of cosine euclidean dotproduct other"},
    "metadata": {"generated_at": "string", "generator": "any_generator", "title": "string", "description": "string", "tags": "list of string", "stats": "object", "layout": "object"},
    "any_generator": {"name": "string", "version": "string"},
}
OPEN = ["parameters", "store_config", "metadata", "any_generator"]
PATTERNS = {"id": r"^[A-Za-z][A-Za-z0-9_.:-]{0,127}$", "commit": r"^[0-9a-f]{7,40}$", "version": r"^1\.[0-9]+$"}
#: Node types that must not, and that must, refer to a registry.
NO_REF = ["input", "output", "condition", "agent"]
NEED_REF = ["llm", "tool", "prompt", "vector_store"]
