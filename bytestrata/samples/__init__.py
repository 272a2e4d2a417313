"""Small images of the formats, written from their layouts, with known contents: what queries and tests run over."""
