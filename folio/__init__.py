"""folio: question answering over document collections as DataFrame plans."""
