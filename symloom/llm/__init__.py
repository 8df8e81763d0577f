"""Training-data operators: search, secrets, chat, near-duplicates, HTML, language, BPE, quality, decontamination, token files.

Nothing outside this folder imports it; deleting it (with ``corpus_pipeline.py``) leaves the rest of the library whole.
"""
