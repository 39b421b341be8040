"""Facts of source files: definitions, references, imports and type bindings.

Parsers are our own: Python's through its ``ast``, the others through a lexer that knows comments, strings, templates
and regular expressions, and recognisers of the declarations and calls of each language. They are approximate where a
grammar would be exact; exotic syntax yields fewer facts, never an error.
"""

from lodestone.parsing.facts import Facts, parse_file, parse_files  # noqa: F401
