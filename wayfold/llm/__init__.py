"""Training-data operators: licences, token files, mixing, search, sharding, deduplication, chat, language.

Nothing outside this folder imports it; ``wayfold.llm.registry`` lists its queries.
"""
