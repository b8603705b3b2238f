"""Views of the given tables as sequences, graphs, alignments and anchors, and the registered queries over them."""
