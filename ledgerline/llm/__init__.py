"""Training-data operators.  Nothing else in the library imports this package.

================  ==========================================================
module            operator
================  ==========================================================
near_dup          1  b-bit MinHash near-duplicates
vector_dup        2  embedding near-duplicates by collision counting
mixing            3  raking to source, language and topic targets
decontam          4  benchmark decontamination with suffix arrays
langid            5  language identification by evidence fusion
licenses          6  licence lookup by canonical digest
html_text         7  main text by composite text density
secrets           8  secret spans by a linear-chain CRF
tokens            9  token counts by rank-synchronous merging
chat              10 chat formatting in budgeted windows (native)
================  ==========================================================
"""
