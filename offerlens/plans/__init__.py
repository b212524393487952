"""offerlens.plans"""
