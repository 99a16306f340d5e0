"""Tables of records and graphs: schemas, reading, writing, codecs."""
