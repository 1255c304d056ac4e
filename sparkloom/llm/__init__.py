"""Operators for large text corpora.  Nothing outside this subpackage imports it.

Conventions shared by every operator here:

* the caller names the id and text columns, other columns never reach the
  operator, so extra columns with clashing names are harmless;
* a null text counts as the empty text, a null id stays null;
* repeated rows give one result each (operators on pairs document their own rule);
* an empty table gives an empty result with the same schema.
"""
