"""Reference times of the registered queries."""

AS_OF = "2024-01-20 00:00:00"
OBLIGATIONS_AS_OF = "1998-01-01"
RENEWALS_AS_OF = "2000-06-30"
