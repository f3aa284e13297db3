"""Part of wavecohort."""
