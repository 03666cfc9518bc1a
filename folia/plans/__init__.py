"""The registered queries of the engine: each reads whole tables and applies one family of operators."""
