"""planspark subpackage."""
