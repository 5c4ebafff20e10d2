"""cuespan.plans"""
